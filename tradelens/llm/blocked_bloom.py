"""Blocked Bloom filters, built by Spark and probed with numpy.

A key sets one bit in each of the eight 64-bit lanes of one 512-bit block, so a probe
touches one cache line. Keys are 64-bit hashes in numbered shards, each shard a filter
of its own. The blocks are OR-merged by partial aggregates; the driver only
puts together what is left, at most ``max_bytes`` in all. More keys than that
fill the filters up: more false positives pass, none is ever missed, and the size
that is broadcast stays the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import map_arrow

LANES = 8
# Eight odd multipliers, one per lane (any odd numbers do).
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D,
                  0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def block_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.uint64(1) << ((low * SALTS[lane]) >> np.uint32(26)).astype(np.uint64)


def may_hold(blocks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter (blocks x lanes) may hold: all that it holds, and some more."""
    found = np.ones(len(hashes), dtype=bool)
    at = block_of(hashes, len(blocks))
    for lane in range(LANES):
        bits = lane_bits(hashes, lane)
        found &= blocks[at, lane] & bits == bits
    return found


def build(keys: DataFrame, bits_per_key: int = 16, max_bytes: int = 64 << 20) -> dict[int, np.ndarray]:
    """Filters by shard of ``keys`` (shard int, hash long); the shards must be few (their
    sizes come to the driver). An empty table gives no filter."""
    counts = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, 8 * max_bytes / max(1, bits_per_key * sum(counts.values())))
    n_blocks = {s: max(1, int(n * bits_per_key * share) // (64 * LANES)) for s, n in counts.items()}

    def partial(batches):
        for batch in batches:
            shards = batch.column(0).to_numpy()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            for shard in np.unique(shards).tolist():
                own = hashes[shards == shard]
                blocks, inverse = np.unique(block_of(own, n_blocks[shard]), return_inverse=True)
                merged = np.zeros((len(blocks), LANES), dtype=np.uint64)
                for lane in range(LANES):
                    np.bitwise_or.at(merged[:, lane], inverse, lane_bits(own, lane))
                columns = [pa.array(np.full(len(blocks), shard, np.int32)), pa.array(blocks),
                           *[pa.array(np.ascontiguousarray(merged[:, lane]).view(np.int64)) for lane in range(LANES)]]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", *names])

    names = [f"l{lane}" for lane in range(LANES)]
    partials = map_arrow(keys.select(F.col("shard").cast("int"), F.col("hash").cast("long")), partial,
                         "shard int, block long, " + ", ".join(f"{n} long" for n in names))
    whole = partials.groupBy("shard", "block").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()
    shards, at = whole["shard"].to_numpy(), whole["block"].to_numpy()
    filters = {}
    for shard, n in n_blocks.items():
        own = shards == shard
        filters[shard] = np.zeros((n, LANES), dtype=np.uint64)
        for lane, name in enumerate(names):
            filters[shard][at[own], lane] = whole[name].to_numpy()[own].view(np.uint64)
    return filters


def size_in_bytes(filters: dict[int, np.ndarray]) -> int:
    return reduce(lambda total, f: total + f.nbytes, filters.values(), 0)
