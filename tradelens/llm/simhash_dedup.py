"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint: bit i is set if more than half of its
word shingles' XXH64 values have it set. Fingerprints that differ in at most
``max_distance`` bits are linked; a group is a connected component.

Search. The 64 bits are cut into segments. If two fingerprints differ in at
most r bits, at least one of m segments differs in at most r // m bits, so it
is enough to enumerate that small Hamming ball around each segment value and
to look the values up among all fingerprints' own segment values. For r = 3
there are two 32-bit segments with balls of radius 1 (33 values; only the half
that raises the value is enumerated, as the other end of a pair does the
rest). Each match is verified on all 64 bits inside the join.

Only distinct fingerprints take part, so exact copies cost nothing. A segment
value shared by more than ``dense_bucket`` fingerprints is not paired up:
there, two fingerprints are within r bits if and only if some point of the
other bits lies within r // 2 of the one and within the rest of the other, so
each member is listed under the points of its ball and everything listed under
a point is linked to one member. That links exactly the same components with a
number of rows linear in the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, map_arrow, text_or_empty
from tradelens.llm.components import connected_components

BITS = 64


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Unsigned 64-bit SimHash of one text (0 if it has no word). Words are runs
    of anything but ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [words[i:] for i in range(min(shingle, len(words)))]
    hashes = [digest(b" ".join(g), seed) for g in zip(*grams)]
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # a very long text in slices
        part = np.array(hashes[start:start + (1 << 16)], dtype="<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; fp is the fingerprint as a signed long."""
    return _keyed_fingerprints(docs, shingle, seed, F.lit(0).cast("long")).select("doc_id", "fp")


def _keyed_fingerprints(docs: DataFrame, shingle: int, seed: int, key) -> DataFrame:
    """``(doc_id, tk, fp)`` per row of ``docs``, tk the value of ``key``."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()]
            signed = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], names=["doc_id", "tk", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), key.alias("tk"), text_or_empty().alias("text")),
                     run, "doc_id long, tk long, fp long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _longs(values: list[int]):
    return F.array(*[F.lit(_as_long(v)).cast("long") for v in values])


def _raised(value, masks: list[int]):
    """The values of a ball around ``value`` that are not below it."""
    return F.filter(F.transform(_longs(masks), lambda m: value.bitwiseXOR(m)), lambda x: x >= value)


def links(nodes: DataFrame, max_distance: int = 3, segments: int = 2,
          dense_bucket: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that join the
    same components as all pairs within ``max_distance`` bits; every edge is such
    a pair, and outside dense buckets every pair is an edge (it may come twice)."""
    if not 2 <= segments <= BITS:
        raise ValueError("segments must be from 2 to 64")
    base, extra = divmod(max_distance, segments)
    cuts = [BITS * i // segments for i in range(segments + 1)]
    own, probes = [], []
    for s in range(segments):
        radius = base if s <= extra else base - 1
        if radius < 0:
            continue
        low, width = cuts[s], cuts[s + 1] - cuts[s]
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_as_long((1 << width) - 1)).cast("long"))
        rest = F.col("fp").bitwiseAND(F.lit(_as_long(((1 << 64) - 1) ^ (((1 << width) - 1) << low))).cast("long"))
        seg = F.lit(s).cast("int").alias("seg")
        own.append(nodes.select(seg, value.alias("value"), "fp", rest.alias("rest")))
        probes.append(nodes.select(seg, "fp", rest.alias("rest"), value.alias("from_value"),
                                   F.explode(_raised(value, _masks(width, radius))).alias("value")))
    own, probes = _union(own), _union(probes)

    dense = cut(own.groupBy("seg", "value").agg(F.count("*").alias("members"))
                .where(F.col("members") > dense_bucket).select("seg", "value"))
    found = []
    if not dense.isEmpty():
        found.append(_dense_links(own, probes, dense, max_distance, cuts))
        own = own.join(dense, ["seg", "value"], "left_anti")
    a, b = own.alias("a"), probes.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    once = (F.col("b.value") != F.col("b.from_value")) | (F.col("b.fp") < F.col("a.fp"))
    found.append(a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.value") == F.col("b.value"))
                        & near & once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    return _union(found)


def _dense_links(own, probes, dense, max_distance, cuts) -> DataFrame:
    """Links inside segment values shared by very many fingerprints (see above)."""
    hub = max_distance // 2
    own, probes = own.join(dense, ["seg", "value"]), probes.join(dense, ["seg", "value"])
    parts = []
    for s in range(len(cuts) - 1):
        low, width = cuts[s], cuts[s + 1] - cuts[s]
        inside = [i for i in range(BITS) if not low <= i < low + width]

        def ball(radius):
            masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(inside, k)]
            return F.explode(F.transform(_longs(masks), lambda m: F.col("rest").bitwiseXOR(m))).alias("point")

        parts.append(own.where(F.col("seg") == s)
                     .select("seg", "value", "fp", F.lit(True).alias("hub"), ball(hub)))
        away = F.bit_count(F.col("value").bitwiseXOR(F.col("from_value")))
        for k in range(max_distance - hub + 1):
            parts.append(probes.where((F.col("seg") == s) & (away == k))
                         .select("seg", "value", "fp", F.lit(False).alias("hub"),
                                 ball(max_distance - k - hub)))
    listed = _union(parts)
    key = ["seg", "value", "point"]
    hubs = cut(listed.where("hub").groupBy(*key).agg(F.min("fp").alias("a")))
    return listed.join(hubs, key).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 3, seed: int = 42,
                          dense_bucket: int = 2048) -> DataFrame:
    """One row per row of ``docs`` (needs ``doc_id`` and ``text``; other columns are
    ignored): ``doc_id``, ``fp`` (signed long), ``fingerprint`` (16 lowercase hex
    digits) and ``component_id``, the smallest doc_id of its group.

    Null or empty texts have fingerprint 0 and are linked like any other. A
    null doc_id never becomes a component_id unless its whole group has none.
    Repeated rows are returned as often as they come. An empty table gives an
    empty result.
    """
    fps = cut(fingerprints(docs, shingle, seed))
    groups = _smallest_of_groups(fps, F.col("doc_id"), max_distance, dense_bucket).withColumnRenamed("smallest", "component_id")
    return fps.join(groups, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _smallest_of_groups(fps: DataFrame, member, max_distance: int, dense_bucket: int) -> DataFrame:
    """``(fp, smallest)`` per fingerprint: the smallest ``member`` of its group."""
    nodes = cut(fps.groupBy("fp").agg(F.min(member).alias("first_id")))
    roots = connected_components(links(nodes, max_distance, dense_bucket=dense_bucket))
    rooted = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("smallest"))
    return cut(rooted.join(smallest, "root").select("fp", "smallest"))


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs``, all columns, without the documents that are not the first of their
    near-duplicate group: the one with the smallest doc_id (any goes before none),
    of equals the one with the smallest hash of its text. Rows that share doc_id and
    text are one document. Only the ids and hashes that go are joined back."""
    fps = cut(_keyed_fingerprints(docs, shingle, 42, F.xxhash64(text_or_empty())))
    member = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("tk").alias("tk"))
    first = _smallest_of_groups(fps, member, max_distance, dense_bucket=2048)
    stays = F.col("doc_id").eqNullSafe(F.col("smallest.id")) & (F.col("tk") == F.col("smallest.tk"))
    gone = cut(fps.join(first, "fp").where(~stays).select(
        F.col("doc_id").alias("__gone"), F.col("tk").alias("__gone_text")).distinct())
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"])
                     & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["__gone_text"]), "left_anti")
