"""Column-expression helpers (money, rounding, bands, tokenizer)."""

from tradelens.functions.bands import band, band_order
from tradelens.functions.numeric import (
    as_double,
    big,
    mean_of,
    money,
    percent,
    round_half_up,
    rounded_ratio,
    safe_ratio,
)

__all__ = [
    "as_double",
    "band",
    "band_order",
    "big",
    "mean_of",
    "money",
    "percent",
    "round_half_up",
    "rounded_ratio",
    "safe_ratio",
]
