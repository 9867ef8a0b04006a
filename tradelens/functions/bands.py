"""CASE-band expressions and the band definitions of the reports.

A band list is an ordered sequence of (lower, upper, label) with inclusive
bounds (SQL BETWEEN); a ``None`` lower bound means "strictly below upper". Rows that match no band
get ``otherwise`` -- exactly like the reference's ``ELSE`` branch, so gaps
between bands (19.99 < x < 20, negative day counts) fall into the last label.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = tuple[object, object, str]

# ---------------------------------------------------------------------------
# Band edges and labels exactly as the reports print them.
# ---------------------------------------------------------------------------
# Freight per order (strictly below 10 for the first band, then BETWEEN).
FREIGHT_BANDS: Sequence[Band] = (
    (None, Decimal("10"), "Under 10"),
    (Decimal("10"), Decimal("19.99"), "10 - 19.99"),
    (Decimal("20"), Decimal("29.99"), "20 - 29.99"),
    (Decimal("30"), Decimal("49.99"), "30 - 49.99"),
)
FREIGHT_OTHERWISE = "50+"

# Days from purchase to delivery.
DELIVERY_BANDS: Sequence[Band] = (
    (0, 5, "0-5 days"),
    (6, 10, "6-10 days"),
    (11, 15, "11-15 days"),
    (16, 20, "16-20 days"),
)
DELIVERY_OTHERWISE = "21+ days"

# Late deliveries (only rows with more than 20 days are kept by that report).
LATE_DELIVERY_BANDS: Sequence[Band] = (
    (20, 30, "20-30 days"),
    (31, 40, "31-40 days"),
    (41, 50, "41-50 days"),
)
LATE_DELIVERY_OTHERWISE = "51+ days"
LATE_AFTER_DAYS = 20

# Days from approval to hand-over to the carrier.
SHIPPING_BANDS: Sequence[Band] = (
    (0, 0, "Same Day"),
    (1, 2, "1-2 Days"),
    (3, 5, "3-5 Days"),
    (6, 10, "6-10 Days"),
)
SHIPPING_OTHERWISE = "10+ Days"


def band(value: Column, bands: Sequence[Band], otherwise: str) -> Column:
    """First matching band label, else ``otherwise`` (a NULL value too)."""
    expr = None
    for lo, hi, label in bands:
        if lo is None:
            cond = value < F.lit(hi)
        else:
            cond = value.between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(otherwise)


def band_order(label: Column, bands: Sequence[Band]) -> Column:
    """Position of a label in its band list; the ELSE label sorts last."""
    expr = None
    for i, (_, _, name) in enumerate(bands, start=1):
        expr = F.when(label == name, i) if expr is None else expr.when(label == name, i)
    return expr.otherwise(len(bands) + 1)

