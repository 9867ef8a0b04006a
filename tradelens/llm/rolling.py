"""Hashes of all windows of a sequence, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# Two odd multipliers of a polynomial modulo 2**64 (any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def item_hashes(items: list[bytes]) -> np.ndarray:
    """XXH64 of every item."""
    return np.fromiter(map(xxhash.xxh64_intdigest, items), dtype=np.uint64, count=len(items))


class Windows:
    """Polynomial hashes of fixed-length windows over item hashes; powers are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            have = len(self.powers)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(b, have, 1 << 64))]))

    def hashes(self, items: np.ndarray, width: int) -> np.ndarray:
        """One unsigned 64-bit hash per window of ``width`` items, in order."""
        n = len(items)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(items * self.powers[:n], out=sums[1:])
        mixed = (sums[width:] - sums[:-width]) * self.inverses[:n - width + 1]
        mixed ^= mixed >> np.uint64(32)  # the low bits of a product know little of the high ones
        return mixed * np.uint64(0xD6E8FEB86659FD93)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of ``width`` items that begins at one of
    ``starts`` (a window may begin before the first item or end after the last)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(starts + width, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
