"""The rounding recipe against exact decimal arithmetic (Python's Decimal,
ROUND_HALF_UP), on random money sums / counts and on exact ties."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tradelens.functions.numeric import percent, round_half_up, rounded_ratio


def _exact(num: Decimal, den: int, digits: int) -> float | None:
    if den == 0:
        return None
    q = Decimal(10) ** -digits
    return float((num / Decimal(den)).quantize(q, rounding=ROUND_HALF_UP))


def _cases(n: int = 4000):
    rng = random.Random(5)
    cases = []
    for _ in range(n):
        den = rng.choice([1, 2, 3, 4, 7, 8, 16, 40, 125, 1000, rng.randrange(1, 10**7)])
        cases.append((Decimal(rng.randrange(-10**9, 10**9)) / 100, den))
    # exact ties at the third decimal: x.xx5 = num / den
    for _ in range(500):
        den = rng.choice([2, 4, 8, 40, 200, 1000])
        tie = Decimal(rng.randrange(0, 10**6) * 10 + 5) / 1000
        cases.append(((tie * den).quantize(Decimal("0.01")), den))
    cases += [(Decimal("1.00"), 0), (Decimal("0.00"), 3), (Decimal("-0.05"), 2)]
    return cases


def test_rounded_ratio_and_percent_match_exact_decimals(spark):
    cases = _cases()
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "num decimal(18,2), den bigint")
    got = df.select(rounded_ratio(F.col("num"), F.col("den"), 2, scales=(2, 0)).alias("r2"),
                    rounded_ratio(F.col("num"), F.col("den"), 4, scales=(2, 0)).alias("r4"),
                    percent(F.col("num"), F.col("den"), scales=(2, 0)).alias("pct")).collect()
    for (num, den), row in zip(cases, got):
        assert row["r2"] == _exact(num, den, 2), (num, den, row)
        assert row["r4"] == _exact(num, den, 4), (num, den, row)
        assert row["pct"] == _exact(num * 100, den, 2), (num, den, row)


def test_exact_ties_at_every_magnitude(spark):
    rng = random.Random(9)
    cases = []
    for mag in (10**2, 10**4, 10**6, 10**8, 10**10):
        for _ in range(300):
            den = rng.choice([10, 30, 70, 400, 1000, 3000])
            m = rng.randrange(0, mag * 100) * 10 + 5      # a tie at the 2nd decimal
            cases.append(((Decimal(m) / 1000 * den).quantize(Decimal("0.01")), den))
    df = spark.createDataFrame(cases, "num decimal(18,2), den bigint")
    got = df.select(rounded_ratio("num", "den", 2, scales=(2, 0)),
                    rounded_ratio("num", F.col("den").cast("decimal(18,2)"), 4,
                                  scales=(2, 2))).collect()
    for (num, den), row in zip(cases, got):
        assert row[0] == _exact(num, den, 2) and row[1] == _exact(num, den, 4), (num, den, row)


def test_round_half_up_on_exact_decimals(spark):
    vals = ["1.005", "2.675", "-1.005", "0.125", "1.115", "10.0049999", "0.005", "-0.005"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals], "x decimal(20,7)")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()]
    assert got == [float(Decimal(v).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for v in vals]


def test_bands_match_a_direct_statement_of_the_rule(spark):
    from tradelens.functions.bands import (
        DELIVERY_BANDS,
        DELIVERY_OTHERWISE,
        FREIGHT_BANDS,
        FREIGHT_OTHERWISE,
        band,
    )

    def expected(x, bands, otherwise):
        if x is None:
            return otherwise
        for lo, hi, label in bands:
            if (x < hi) if lo is None else (lo <= x <= hi):
                return label
        return otherwise

    rng = random.Random(3)
    values = [Decimal(rng.randrange(-500, 60000)) / 1000 for _ in range(3000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x decimal(10,3)")
    got = [r[0] for r in df.select(band(F.col("x"), FREIGHT_BANDS, FREIGHT_OTHERWISE)).collect()]
    assert got == [expected(v, FREIGHT_BANDS, FREIGHT_OTHERWISE) for v in values]
    days = [rng.randrange(-5, 40) for _ in range(500)] + [None]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r[0] for r in df.select(band(F.col("d"), DELIVERY_BANDS, DELIVERY_OTHERWISE)).collect()]
    assert got == [expected(d, DELIVERY_BANDS, DELIVERY_OTHERWISE) for d in days]
