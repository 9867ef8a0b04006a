"""Hot keys: one person / seller / order holding a large share of the rows.
Results are checked against a brute-force computation in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

from conftest import customer, item, make_roles, order, ts

from tradelens.operators import customers as cust
from tradelens.operators import sales


def _skewed_orders(rng: random.Random, hot_share: int = 200, others: int = 60):
    orders, customers = [], [customer("hot", "H")]
    for i in range(hot_share):
        orders.append(order(f"h{i}", "hot", purchase=ts(rng.randrange(0, 400), rng.randrange(24))))
    for i in range(others):
        cid = f"c{i % 15}"
        orders.append(order(f"o{i}", cid, purchase=ts(rng.randrange(0, 400))))
    customers += [customer(f"c{i}", f"P{i % 7}") for i in range(15)]
    return orders, customers


def test_order_gaps_with_a_hot_person_spanning_partitions(spark):
    rng = random.Random(7)
    orders, customers = _skewed_orders(rng)
    r = make_roles(spark, orders=orders, customers=customers)
    got = {(row["order_id"]): row["prev_purchase_time"]
           for row in cust.order_gaps(r.orders.repartition(6), r.customers).collect()}

    person = {c[0]: c[1] for c in customers}
    by_person = defaultdict(list)
    for o in orders:
        by_person[person[o[1]]].append((o[3], o[0]))
    want = {}
    for rows in by_person.values():
        rows.sort()
        prev = None
        for t, oid in rows:
            want[oid] = prev
            prev = t
    assert got == want


def test_seller_review_summary_with_a_hot_order_matches_brute_force(spark):
    rng = random.Random(11)
    orders = [order(f"o{i}", "c1", status=rng.choice(["delivered", "shipped", "canceled"]))
              for i in range(30)]
    items, reviews = [], []
    for n in range(400):  # order o0 holds most item rows
        oid = "o0" if n % 3 else f"o{rng.randrange(30)}"
        items.append(item(oid, sid=f"s{rng.randrange(4)}", price=f"{rng.randrange(1, 5000) / 100:.2f}"))
    for n in range(40):
        oid = f"o{rng.randrange(30)}"
        reviews.append((f"r{n % 25}", oid, rng.choice([1, 2, 3, 4, 5, None]), None, None))
    r = make_roles(spark, orders=orders, items=items, reviews=reviews)
    got = {row["seller_id"]: tuple(row)[1:]
           for row in sales.seller_revenue_review_summary(r.items, r.orders, r.reviews).collect()}

    status = {o[0]: o[2] for o in orders}
    rev_by_order = defaultdict(list)
    for rv in reviews:
        rev_by_order[rv[1]].append(rv)
    acc = defaultdict(lambda: [Decimal(0), set(), [], set()])
    for oid, _pid, sid, price, _f in items:
        if status[oid] not in ("delivered", "shipped"):
            continue
        a = acc[sid]
        a[1].add(oid)
        for rv in rev_by_order.get(oid) or [(None, oid, None, None, None)]:
            a[0] += price
            if rv[2] is not None:
                a[2].append(rv[2])
            if rv[0] is not None:
                a[3].add(rv[0])

    def r2(x):
        return float(Decimal(x).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"))

    want = {sid: (float(a[0]), len(a[1]), r2(a[0] / len(a[1])),
                  r2(Decimal(sum(a[2])) / len(a[2])) if a[2] else None, len(a[3]))
            for sid, a in acc.items()}
    assert got == want


def test_a_hot_key_of_an_anti_join_is_split(spark):
    from pyspark.sql import functions as F

    from tradelens.operators.audits import payments_without_orders

    n = 60_000  # half of the payments have one order, a tenth have none
    payments = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None)
                                     .otherwise(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("order_id"))
    orders = spark.range(0, n, 3).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("order_id"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = payments_without_orders(payments.repartition(8), orders)
        counts = {r["order_id"]: r["count"] for r in found.groupBy("order_id").count().where("order_id is null or order_id = 'hot'").collect()}
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = [None if i % 2 and i % 10 == 1 else "hot" if i % 2 == 0 else f"o{i}" for i in range(n)]
    assert counts == {"hot": n // 2, None: n // 10}
    assert len(rows) == sum(w is None or w == "hot" or int(w[1:]) % 3 != 0 for w in want)
    assert "skew=true" in plan
