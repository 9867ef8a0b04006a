"""Sharding by extendible hashing, DataFrame functions only.

A record's hash is 60 bits of an MD5. The directory is indexed by hash-prefix
bits: shard ``p`` of depth d holds the records whose hash begins with the d bits
p. All start at depth 0 and only an oversized bucket splits on its next bit, until
every shard fits the byte limit.

The directory is found without touching records again for every bit: bytes are
summed once per *cell* (a prefix of ``step`` more bits than the table's size
calls for), a cell's bytes count for all its ancestors, and the shards are the
prefixes that fit while their parent does not. Only cells that are still too big
are opened again with the next bits, from their records alone.

What no bit can part -- records equal in every hashed column, such as a third of
a table being one repeated row -- is cut by running totals of bytes: the records
are numbered in salted groups, and a group's numbers are shifted by the bytes of
the groups before. A single record above the limit is a shard of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut, small_or_shuffled, text_or_empty

BITS = 60


def hash_bits(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns' texts (null: empty), as a long."""
    joined = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int, of: str = "hash") -> Column:
    return F.shiftright(of, BITS - depth)


def _opened(records: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Directory entries (depth, prefix, bytes) between depths ``low`` and ``high``,
    and the prefixes of depth ``high`` that are still too big. Every record is known to lie in a
    prefix of depth ``low`` - 1 above the limit (or low is 0)."""
    cells = cut(records.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    depths = F.array(*[F.lit(d) for d in range(low, high + 1)])
    every = cells.select("bytes", "n", "cell", F.explode(depths).alias("depth")).select(
        "depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"), "bytes", "n")
    sizes = cut(every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    fits = sizes.where(F.col("bytes") <= limit)
    full = sizes.where(F.col("bytes") > limit)
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    below = fits.where(F.col("depth") > low).withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
    shards = fits.where(F.col("depth") == low).unionByName(below.select(*fits.columns))
    return shards, full.where(F.col("depth") == high).select(F.col("prefix").alias("cell"))


def _assigned(records: DataFrame, limit: int, step: int) -> DataFrame:
    """``records`` (hash, bytes, row) with shard_id, shard_depth and shard_bytes."""
    total = records.agg(F.sum("bytes")).first()[0] or 0
    low, rest, done = 0, records, []
    high = min(BITS, max(0, (max(1, -(-total // limit)) - 1).bit_length()) + step)
    while True:
        shards, big = _opened(rest, low, high, limit)
        big = cut(big)
        # A shard of depth d is what 2 ** (high - d) directory cells point to.
        pointers = cut(shards.select(
            "depth", "prefix", F.col("bytes").alias("shard_bytes"),
            F.explode(F.expr(f"sequence(shiftleft(prefix, {high} - depth), "
                             f"shiftleft(prefix + 1L, {high} - depth) - 1L)")).alias("cell")))
        by_cell = rest.withColumn("cell", _prefix(high))
        done.append(by_cell.join(small_or_shuffled(pointers, 500_000), "cell").select(
            "row", "bytes", _shard_name().alias("shard_id"), F.col("depth").alias("shard_depth"), "shard_bytes"))
        if big.isEmpty():
            break
        rest = cut(by_cell.join(big, "cell", "left_semi").drop("cell"))
        if high == BITS:
            done.append(_by_totals(rest, limit))
            break
        low, high = high + 1, min(BITS, high + 16)
    return reduce(DataFrame.unionByName, done)


def _shard_name() -> Column:
    """The prefix bits; the empty prefix is written as a dot."""
    return F.when(F.col("depth") == 0, ".").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))


def _by_totals(rest: DataFrame, limit: int) -> DataFrame:
    """Cut records of one hash into shards by running totals of their bytes, inside
    evenly dealt groups. A part begins anew every limit - largest + 1 bytes, so
    it holds at most ``limit`` bytes unless a single record is larger."""
    dealt = cut(rest.repartition(max(2, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
                .withColumn("deal", F.spark_partition_id()))
    group = Window.partitionBy("hash", "deal")
    running = group.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("nth", F.monotonically_increasing_id())
    before = F.coalesce(F.sum("bytes").over(running), F.lit(0))
    stretch = F.greatest(F.lit(limit) - F.max("bytes").over(group) + 1, F.lit(1))
    parts = cut(numbered.select("row", "hash", "bytes", "deal", F.floor(before / stretch).cast("long").alias("part")))
    sizes = cut(parts.groupBy("hash", "deal", "part").agg(F.sum("bytes").alias("shard_bytes")))
    return parts.join(sizes, ["hash", "deal", "part"]).select(
        "row", "bytes", F.concat_ws("-", F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), BITS, "0"), "deal", "part").alias("shard_id"),
        F.lit(BITS).alias("shard_depth"), "shard_bytes")


def assign_shards(docs: DataFrame, limit: int, carry: list[str] | None = None, step: int = 3) -> DataFrame:
    """``docs`` (the columns in ``carry``, all by default) with ``n_bytes`` (UTF-8
    bytes of the text), ``shard_id`` (the shard's prefix bits, "." for none),
    ``shard_depth`` and ``shard_bytes``, which never exceeds ``limit`` unless one
    record does, which then is alone (with empty ones at most).

    The hash is over doc_id and text, null as empty. Empty texts are records of 0
    bytes. Repeated rows share all hash bits and are told apart by running
    totals where they exceed a shard. An empty table gives no rows. Columns
    of the results' names in ``docs`` are replaced.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    own = [c for c in (carry or docs.columns) if c not in ("n_bytes", "shard_id", "shard_depth", "shard_bytes")]
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
                          hash_bits(F.col("doc_id"), F.col("text")).alias("hash"),
                          F.octet_length(text_or_empty()).cast("long").alias("bytes"))
    return _assigned(records, limit, step).select(
        "row.*", F.col("bytes").alias("n_bytes"), "shard_id", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """One Parquet folder per shard under ``path``, with all of the documents' columns."""
    assigned = assign_shards(docs, limit)
    (assigned.repartition("shard_id").drop("n_bytes", "shard_depth", "shard_bytes")
     .write.mode("overwrite").partitionBy("shard_id").parquet(path))
