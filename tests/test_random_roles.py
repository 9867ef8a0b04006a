"""Differential test on random role tables: every report in Spark against the
same oracle SQL in DuckDB, over data the test-table binding never produces --
NULL statuses, times, scores, categories, states and persons; duplicate review
ids across orders; several reviews per order; zero prices; freight on the band
edges; clock times inside a day; orphans on every key; and (seed 3) repeated
order, customer, product and category keys, which make every join fan out --
the case the pre-aggregations before joins must reproduce exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import random
from decimal import Decimal

import duckdb
import pytest
from conftest import make_roles

from tradelens.plans.catalog import REPORTS
from tradelens.plans.oracle import FIXTURE_BINDINGS, build_oracle

BASE = dt.datetime(2021, 3, 1)
WORDS = ["produto", "Ótimo", "entrega", "não", "gostei!", "Don't", "good", "the", "R$5,00",
         "prazo...", "recomendo", "ruim", "chegou", "a b", "muito", "é", "bom"]


def _maybe(rng, value, p_null=0.1):
    return None if rng.random() < p_null else value


def _money(rng, hi=500):
    return Decimal(rng.randrange(0, hi * 100)) / 100


def _random_rows(seed: int, duplicates: bool = False):
    rng = random.Random(seed)
    statuses = ["delivered", "delivered", "shipped", "canceled", "invoiced", None]
    orders = []
    for i in range(120):
        purchase = _maybe(rng, BASE + dt.timedelta(days=rng.randrange(60), minutes=rng.randrange(1440)),
                          0.04)
        approved = None if purchase is None else _maybe(
            rng, purchase + dt.timedelta(hours=rng.randrange(0, 80)))
        carrier = None if approved is None else _maybe(
            rng, approved + dt.timedelta(hours=rng.randrange(-30, 300)))
        delivered = None if purchase is None else _maybe(
            rng, purchase + dt.timedelta(hours=rng.randrange(-50, 1000)), 0.15)
        cid = _maybe(rng, f"c{rng.randrange(30)}", 0.02)
        orders.append((f"o{i}", cid, rng.choice(statuses), purchase, approved, carrier, delivered))
    order_ids = [o[0] for o in orders]
    payments = [(rng.choice(order_ids[:110] + ["x1", "x2"]),
                 _maybe(rng, rng.choice(["credit_card", "boleto", "voucher"]), 0.05),
                 _maybe(rng, rng.randrange(1, 13), 0.05), _maybe(rng, _money(rng), 0.03))
                for _ in range(200)]
    edges = [Decimal(x) for x in ("9.99", "10.00", "19.99", "20.00", "29.99", "49.99", "50.00",
                                  "0.00", "5.00")]
    items = []
    for _ in range(320):
        oid = rng.choice(order_ids[:100] + ["x3"])
        freight = rng.choice(edges) if rng.random() < 0.5 else _maybe(rng, _money(rng, 60), 0.05)
        price = Decimal("0.00") if rng.random() < 0.05 else _money(rng)
        items.append((oid, f"p{rng.randrange(42)}", f"s{rng.randrange(11)}", price, freight))
    products = [(f"p{i}", rng.choice(["cat_a", "cat_b", "cat_c", "untranslated", None]),
                 _maybe(rng, float(rng.randrange(50, 5000))), _maybe(rng, float(rng.randrange(1, 60))),
                 float(rng.randrange(1, 60)), float(rng.randrange(1, 60)))
                for i in range(40)]
    translation = [("cat_a", "A"), ("cat_b", "B"), ("cat_c", "C")]
    customers = [(f"c{i}", _maybe(rng, f"u{i // 2}", 0.03), rng.choice(["01000", "02000", "03000"]),
                  rng.choice(["x", "y"]), _maybe(rng, rng.choice(["SP", "RJ", "MG", "BA"]), 0.05))
                 for i in range(28)]
    sellers = [(f"s{i}",) for i in range(12) if i != 7]
    reviews = []
    for j in range(90):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 8)))
        title = rng.choice([None, "", "  ", "Ótimo!", "Don't buy", "ok"])
        message = rng.choice([None, "  ", text, text + "\tfim"])
        reviews.append((f"r{j % 75}", rng.choice(order_ids + ["x4"]),
                        _maybe(rng, rng.randrange(1, 6), 0.2), title, message))
    if duplicates:  # repeated keys: every join below fans out like the SQL does
        orders += [(o[0], o[1], rng.choice(statuses), o[3], o[4], o[5], o[6])
                   for o in rng.sample(orders, 12)]
        customers += [(c[0], c[1], c[2], c[3], rng.choice(["SP", "RJ"])) for c in customers[:3]]
        products += [(p[0], rng.choice(["cat_a", "cat_b", None]), *p[2:]) for p in products[:4]]
        translation += [("cat_a", "A2")]
    return dict(orders=orders, payments=payments, items=items, products=products,
                translation=translation, customers=customers, sellers=sellers, reviews=reviews)


def _norm(v):
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("seed,duplicates", [(1, False), (2, False), (3, True)])
def test_reports_match_oracle_on_random_roles(spark, tmp_path, seed, duplicates):
    roles = make_roles(spark, **_random_rows(seed, duplicates))
    con = duckdb.connect()
    for role in ("orders", "payments", "items", "products", "translation", "customers",
                 "sellers", "reviews"):
        path = str(tmp_path / role)
        getattr(roles, role).write.parquet(path)
        con.execute(f"CREATE VIEW fx_{role} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    oracle = build_oracle(FIXTURE_BINDINGS)
    failures = []
    for name, report in REPORTS.items():
        sdf = report(roles, spark)
        rel = con.sql(oracle[name])
        if sorted(sdf.columns) != sorted(rel.columns):
            failures.append((name, "columns", sdf.columns, rel.columns))
            continue
        order = [rel.columns.index(c) for c in sdf.columns]
        s_rows = _sorted([tuple(_norm(v) for v in r) for r in sdf.collect()])
        d_rows = _sorted([tuple(_norm(r[i]) for i in order) for r in rel.fetchall()])
        if s_rows != d_rows:
            failures.append((name, [r for r in s_rows if r not in d_rows][:2],
                             [r for r in d_rows if r not in s_rows][:2]))
    assert not failures, failures
