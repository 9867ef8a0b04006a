from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradelens.session import local_session  # noqa: E402
from tradelens.sources.roles import SCHEMAS, Roles  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cores=4, shuffle_partitions=4, app="tradelens-tests",
                      folder=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


def ts(day: int, hh: int = 0, mm: int = 0) -> dt.datetime:
    """Timestamp ``day`` days after 2020-01-01."""
    return dt.datetime(2020, 1, 1, hh, mm) + dt.timedelta(days=day)


def d(x: str) -> Decimal:
    return Decimal(x)


def order(oid, cid, status="delivered", purchase=None, approved=None, carrier=None,
          delivered=None):
    return (oid, cid, status, purchase if purchase is not None else ts(0), approved, carrier,
            delivered)


def item(oid, pid="p1", sid="s1", price="10.00", freight="1.00"):
    return (oid, pid, sid, d(price), d(freight))


def customer(cid, person, state="SP", city="sao paulo", zipc="01000"):
    return (cid, person, zipc, city, state)


def make_roles(spark, **rows) -> Roles:
    """Roles from literal rows; missing roles are empty tables."""
    frames = {}
    for role, schema in SCHEMAS.items():
        frames[role] = spark.createDataFrame(rows.get(role, []), schema)
    return Roles(**frames)
