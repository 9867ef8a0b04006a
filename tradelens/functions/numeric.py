"""Money, rounding and ratio expressions shared by every report.

All of them are plain Catalyst expressions, so they stay inside whole-stage
codegen. The same arithmetic is written in the DuckDB oracle (plans/oracle.py),
so both engines produce identical values:

* money is summed as DECIMAL(18,2): exact and independent of summation order;
  a rounded sum goes through DECIMAL(38,10) and rounds half away from zero
  (MySQL's rule for exact values);
* a rounded ratio of exact inputs (money sums, counts) is :func:`exact_ratio`:
  HALF_UP of the exact rational value by DECIMAL(38,0) remainder arithmetic
  (HUGEINT in the oracle), ties included at any magnitude -- checked against
  Python's Decimal in tests/test_numeric.py;
* unrounded averages are one DOUBLE / DOUBLE division (identical in both
  engines); only the averages of per-order DOUBLE ratios (R17, R18) are summed
  as DOUBLE and therefore rounded to 8 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_TYPE = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Cast an amount to the exact money type used for every sum."""
    return _col(c).cast(MONEY_TYPE)


def as_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def round_half_up(c: Column | str, digits: int) -> Column:
    """ROUND(x, digits) with half-away-from-zero on the decimal value of x."""
    return F.round(_col(c).cast("decimal(38,10)"), digits).cast("double")


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (MySQL's x / 0)."""
    return F.try_divide(as_double(num), as_double(den))


def _as_integer(c: Column | str, shift: int) -> Column:
    """c * 10^shift as an exact DECIMAL(38,0); c has at most ``shift`` decimals."""
    return (_col(c).cast("decimal(38,6)")
            * F.lit(10 ** shift).cast(f"decimal({shift + 1},0)")).cast("decimal(38,0)")


def exact_ratio(num: Column | str, den: Column | str, digits: int, num_scale: int,
                den_scale: int) -> Column:
    """ROUND(num / den, digits), half away from zero, of the exact rational
    value, as DOUBLE; NULL when den is 0 or NULL.

    ``num`` / ``den`` are exact numbers with at most ``num_scale`` /
    ``den_scale`` decimals (money 2, counts 0). With P = num * 10^(a+b+k) and
    Q = den * 10^(a+b) both integers, the result is sign * floor((2|P| + |Q|) /
    (2|Q|)) / 10^k, computed with DECIMAL(38,0) remainder arithmetic -- exact
    for any magnitude up to 10^32, unlike a DOUBLE quotient, whose ~16
    significant digits can move an exact .5 tie to the lower side.
    """
    p = _as_integer(num, num_scale + den_scale + digits)
    q = _as_integer(den, num_scale + den_scale)
    t = F.abs(p) * 2 + F.abs(q)
    d = F.abs(q) * 2
    units = (t - t % d) / d
    signed = F.when((p < 0) != (q < 0), -units).otherwise(units)
    return F.when(q != 0, (signed / F.lit(10 ** digits)).cast("double"))


def rounded_ratio(num: Column | str, den: Column | str, digits: int = 2, *,
                  scales: tuple[int, int]) -> Column:
    """ROUND(num / den, digits) of exact inputs; ``scales`` = decimals of (num, den)."""
    return exact_ratio(num, den, digits, *scales)


def percent(part: Column | str, whole: Column | str, digits: int = 2, *,
            scales: tuple[int, int]) -> Column:
    """ROUND(100 * part / whole, digits); NULL on a zero denominator."""
    return exact_ratio(_col(part) * 100, whole, digits, *scales)


def mean_of(total: Column | str, count: Column | str, digits: int | None = 2, *,
            scale: int) -> Column:
    """Average as exact sum / count (``scale`` = decimals of the sum); with
    ``digits=None`` the unrounded DOUBLE quotient."""
    if digits is None:
        return safe_ratio(total, count)
    return exact_ratio(total, count, digits, scale, 0)


def year_month(c: Column | str) -> Column:
    """'yyyy-MM' of a timestamp from its calendar fields (no session time zone)."""
    ts = _col(c)
    return F.when(ts.isNotNull(), F.format_string("%04d-%02d", F.year(ts), F.month(ts)))


def big(c: Column | str) -> Column:
    """Integer outputs are BIGINT on both engines."""
    return _col(c).cast("bigint")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
