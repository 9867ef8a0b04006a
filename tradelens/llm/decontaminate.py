"""Benchmark decontamination: SimHash of item-sized windows, DataFrame functions only.

A benchmark item of L words is looked for in windows of L words. Windows and
items are weighted sets of five-word shingles (a shingle weighs as often as it
comes). A window is contaminated if the weighted Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones, is at least 0.8.

1. *Windows.* A window without a shingle of any item has similarity 0 with all
   of them, so only windows around shared shingles need a fingerprint. Each
   shared shingle says where the item would start; between two such starts of
   one item all windows are taken. (Sliding a window towards the next start loses
   no shared shingle, so the most similar window of an item is among these.)
2. *SimHash.* 64 bits over the window's shingle hashes, bit i set if more than
   half of the weight has it set.
3. *Multi-index Hamming blocks.* Fingerprints are cut into blocks; if two differ
   in at most r bits, some block differs in at most r // blocks bits (in r // blocks - 1
   from the (r % blocks + 2)-th block on). The items' small Hamming balls are
   enumerated per block and the windows' blocks looked up among them: every
   pair within the radius is found. Pairs beyond the radius are dropped.
4. *Verification.* The exact weighted similarity on the shingles' text.

Two sets of equal size with similarity 0.8 share 8/9 of their weight, an angle
whose expected distance is 9.7 of 64 bits (standard deviation 2.9): the default
radius 20 is three and a half deviations further out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut, limited, small_or_shuffled, text_or_empty

BITS = 64
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_array(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def shingle_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash per n-word shingle of ``words``, in order; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<long>"))


def shingle_texts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash (signed long) of an array of hashes, repeats weighing."""
    def bit(i):
        ones = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    value = bit(0)
    for i in range(1, BITS):
        value = value.bitwiseOR(bit(i))
    return value


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as weighted sets: equal elements are told apart by their
    ordinal, which makes the smaller weights the size of a plain intersection."""
    def numbered(x):
        return F.transform(x, lambda e, i: F.concat_ws("\u0001", e, F.size(F.filter(F.slice(x, 1, i), lambda y: y == e)).cast("string")))

    shared = F.size(F.array_intersect(numbered(a), numbered(b)))
    return shared / (F.size(a) + F.size(b) - shared)


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` blocks."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _block_value(fp: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _block_values(k: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(k).alias("block"), v.alias("value")))


def _ball(own: Column, width: int, radius: int) -> Column:
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= radius)
    return F.transform(masks, lambda m: own.bitwiseXOR(m))


def _block_rows(df: DataFrame, parts: int, radius: int | None = None) -> DataFrame:
    """Explode ``df`` to one row per block value of ``fp``; with a radius, per value
    in the Hamming balls that guarantee to meet it."""
    listed = []
    for k, (low, width) in enumerate(blocks(BITS, parts)):
        own = _block_value("fp", low, width)
        r = 0 if radius is None else radius // parts - (0 if k <= radius % parts else 1)
        if r >= 0:
            listed.append(_block_values(k, F.array(own) if radius is None else _ball(own, width, r)))
    return df.select("*", F.explode(F.concat(*listed)).alias("b")).select("*", "b.block", "b.value").drop("b")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8,
                         radius: int = 20, parts: int = 6, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per (doc_id, item_id) with a contaminated window: the most similar
    one's ``start`` (words before it), ``n_words``, ``similarity`` and
    ``hamming``; of equals the first. ``docs`` needs doc_id and text, ``benchmark`` item_id and
    text; other columns are ignored.

    Null or empty texts contain nothing. An item of fewer words than a shingle is
    one shingle of its own length; a wordless item is never found. A document shorter than an item is one
    window. Rows that repeat a doc_id count as one document with several
    texts. Empty tables give no rows.
    """
    verified = _verified(docs, benchmark, shingle, similarity, radius, parts, max_broadcast_rows)
    best = F.max_by(F.struct("start", "n", "similarity", "hamming"),
                    F.struct("similarity", -F.col("start"), -F.col("hamming")))
    return verified.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n").cast("long").alias("n_words"),
        "best.similarity", F.col("best.hamming").cast("long").alias("hamming"))


def _verified(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20,
              parts: int = 6, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """All contaminated windows, with the ``text_key`` (xxhash64) of their text."""
    worded_items = (benchmark.select("item_id", word_array(text_or_empty()).alias("w")).where(F.size("w") > 0)
                    .select("item_id", F.size("w").alias("item_words"), "w"))
    own = F.least("item_words", F.lit(shingle))
    lengths = sorted(r["own"] for r in worded_items.select(own.alias("own")).distinct().collect()) or [shingle]
    items = cut(_union([
        worded_items.where(own == k)
        .select("item_id", "item_words", F.lit(k).alias("own"), shingle_texts(F.col("w"), k).alias("item_shingles"),
                shingle_hashes(F.col("w"), k).alias("hashes")) for k in lengths])
        .select("item_id", "item_words", "own", "item_shingles", "hashes", simhash(F.col("hashes")).alias("item_fp")))
    anchors = cut(items.select("item_id", "item_words", "own", F.posexplode("hashes").alias("at", "hash")))

    # 1. windows
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), word_array(F.col("text")).alias("w"))
    listed = _union([worded.select("doc_id", "text_key", F.size("w").alias("doc_words"), F.lit(k).alias("own"),
                                   F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "hash")) for k in lengths])
    shared = listed.join(small_or_shuffled(anchors, max_broadcast_rows), ["own", "hash"])
    starts = shared.select("doc_id", "text_key", "doc_words", "item_id", "item_words",
                           (F.col("pos") - F.col("at")).alias("start")).distinct()
    following = F.lead("start").over(Window.partitionBy("doc_id", "text_key", "item_id").orderBy("start"))
    gap = F.col("next") - F.col("start")
    filled = starts.withColumn("next", following).select(
        "doc_id", "text_key", "item_words",
        F.explode(F.when(gap <= 2 * F.col("item_words"), F.sequence("start", F.col("next") - 1))
                  .otherwise(F.array("start"))).alias("start"),
        F.greatest(F.col("doc_words") - F.col("item_words"), F.lit(0)).alias("last"))
    wanted = cut(filled.select("doc_id", "text_key", F.struct(
        F.greatest(F.least("start", "last"), F.lit(0)).alias("start"), F.col("item_words").alias("n")).alias("window"))
        .groupBy("doc_id", "text_key").agg(F.collect_set("window").alias("windows")))

    # 2. fingerprints
    keys = ["doc_id", "text_key"]
    wanted = limited(wanted.withColumnsRenamed({k: f"_{k}" for k in keys}), F.size("windows"), max_broadcast_rows)
    windows = (worded.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")))
               .dropDuplicates(keys)
               .select(*keys, "w", F.explode("windows").alias("window"))
               .select(*keys, "window.start", "window.n", F.slice("w", F.col("window.start") + 1, F.col("window.n")).alias("w")))
    windows = cut(_union([
        windows.where(F.least("n", F.lit(shingle)) == k)
        .select(*keys, "start", "n", shingle_texts(F.col("w"), k).alias("shingles"),
                simhash(shingle_hashes(F.col("w"), k)).alias("fp")) for k in lengths]))

    # 3. blocks
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    probes = cut(_block_rows(items.select("item_id", F.col("item_words").alias("n"), F.col("item_fp").alias("fp")), parts, radius)
                 .select("item_id", "n", F.col("fp").alias("item_fp"), "block", "value"))
    pairs = (_block_rows(windows.select(*keys, "start", "n", "fp"), parts)
             .join(small_or_shuffled(probes, max_broadcast_rows), ["n", "block", "value"])
             .withColumn("hamming", near).where(F.col("hamming") <= radius)
             .select(*keys, "start", "n", "item_id", "hamming").distinct())

    # 4. verification
    joined = (pairs.withColumnsRenamed({k: f"_{k}" for k in [*keys, "start", "n"]})
              .join(windows, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
                    & (F.col("start") == F.col("_start")) & (F.col("n") == F.col("_n")))
              .join(small_or_shuffled(items.select("item_id", "item_shingles"), max_broadcast_rows // 10), "item_id"))
    return joined.select("doc_id", "text_key", "item_id", "start", "n", "hamming",
                         weighted_jaccard(F.col("shingles"), F.col("item_shingles")).alias("similarity")
                         ).where(F.col("similarity") >= similarity)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that contain a benchmark item.
    Rows that share a doc_id, or have none, are told apart by their text."""
    leaked = cut(_verified(docs, benchmark).select(
        F.col("doc_id").alias("__leaked"), F.col("text_key").alias("__leaked_text")).distinct())
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(leaked["__leaked"])
                     & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == leaked["__leaked_text"]), "left_anti")
