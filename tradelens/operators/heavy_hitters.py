"""Exact top-k of counts over very many keys (P52, R35, T07) without shuffling every key.

The plain way sends each task's distinct keys through the shuffle. Here three scans send little:

1. A frequent-items state per group (``approx_top_k``, mergeable, bounded by ``tracked``) names candidates.
2. One aggregate counts the candidates exactly, and all rows per hash slot. The k-th largest candidate
   count is a lower bound of the k-th largest count; a slot's total is an upper bound of each of its keys.
3. Only keys of slots that reach the bound are counted; no other key can be among the first k, ties included.

The result does not rest on the sketch: any candidates give a valid bound, fewer or worse ones only let
more slots through. Where the counts are flat every slot passes and step 3 is the plain way.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import big

#: Hash slots: at most so many numbers are broadcast in step 3, whatever the groups.
SLOTS = 8192
#: Keys a frequent-items state tracks; candidates per place asked for.
TRACKED = 4096
SPARE = 4
#: Broadcast candidates: at most so many, of keys of at most so many characters. Others take the way of all keys.
MAX_CANDIDATES = 100_000
MAX_KEY_CHARS = 256


def _candidates(rows: DataFrame, group: Sequence[str], key: str, k: int, tracked: int) -> DataFrame:
    wanted = SPARE * k
    top = F.call_function("approx_top_k", F.col(key), F.lit(wanted), F.lit(max(tracked, wanted)))
    return (rows.groupBy(*group).agg(top.alias("top"))
            .select(*[F.col(g).alias(f"of_{g}") for g in group], F.explode("top.item").alias("candidate"))
            .where(F.length(F.col("candidate").cast("string")) <= MAX_KEY_CHARS)
            .limit(MAX_CANDIDATES))


def _slot(slots: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots))


def top_k(rows: DataFrame, key: str, k: int, group: Sequence[str] = (), weights: DataFrame | None = None,
          slots: int = SLOTS, tracked: int = TRACKED) -> DataFrame:
    """*group, key, n: per group the ``k`` keys with the most rows, ties by key (NULL first).

    A NULL key is a key and a NULL group a group. Group columns have few values (scores, states).
    ``weights`` (without groups only): key, further columns, weight. The counts meet it in an inner join on
    the key (NULL meets nothing);
    result rows are key, its further columns and n = rows x weight, ties by these columns in order.
    An empty table has no row; ``k`` below 1 is refused.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if weights is not None and group:
        raise ValueError("weights go without groups")
    group, extra = list(group), [c for c in weights.columns if c not in (key, "weight")] if weights is not None else []
    names = [*group, key, *extra]
    # neutral names inside, so that no column of the caller clashes
    inside = {g: f"g{i}" for i, g in enumerate(group)} | {key: "key"} | {c: f"x{i}" for i, c in enumerate(extra)}
    gs, xs = [inside[g] for g in group], [inside[c] for c in extra]
    rows = rows.select(*[F.col(c).alias(inside[c]) for c in [*group, key]])
    slot = _slot(slots, *gs, "key")

    def weighted(counts: DataFrame) -> DataFrame:
        if weights is None:
            return counts
        w = (weights.where(F.col(key).isNotNull())
             .select(F.col(key).alias("of_key"), *[F.col(c).alias(inside[c]) for c in extra], "weight"))
        # null-safe, so that no filter on the key is pushed below ``counted`` and both its readers share one exchange
        return (counts.join(w, F.col("key").eqNullSafe(F.col("of_key")))
                .select("key", *xs, (F.col("n") * F.col("weight")).alias("n")))

    candidates = F.broadcast(_candidates(rows, gs, "key", k, tracked))
    same = functools.reduce(operator.and_, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in gs],
                            F.col("key") == F.col("candidate"))
    hit = F.col("candidate").isNotNull()
    # one number, negative for a candidate: with a second column each reader would prune to an aggregate of its own
    counted = (rows.join(candidates, same, "left")
               .groupBy(*gs, slot.alias("slot"), F.when(hit, F.col("key")).alias("key"))
               .agg(F.sum(F.when(hit, -1).otherwise(1)).alias("signed")))

    place = Window.partitionBy(*gs).orderBy(F.desc("n"), "key", *xs)
    bound = (weighted(counted.where("signed < 0").select(*gs, "key", F.negate("signed").alias("n")))
             .withColumn("place", F.row_number().over(place)).where(F.col("place") == k)
             .select(*[F.col(g).alias(f"of_{g}") for g in gs], F.col("n").alias("least")))
    totals = counted.groupBy(*gs, "slot").agg(F.sum(F.abs("signed")).alias("total"))
    if weights is not None:
        heaviest = (weights.select(F.col(key).alias("key"), "weight")
                    .groupBy(_slot(slots, "key").alias("slot")).agg(F.max("weight").alias("weight")))
        totals = totals.join(heaviest, "slot", "left").select(
            "slot", (F.col("total") * F.coalesce("weight", F.lit(0))).alias("total"))
    # a group with fewer than k candidates has no bound: all its slots pass
    if gs:
        reach = functools.reduce(operator.and_, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in gs])
    else:  # the one bound as a row per slot: an equality to join on, in the same job
        bound = bound.select("least", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("of_slot"))
        reach = F.col("slot") == F.col("of_slot")
    totals = totals.join(bound, reach, "left")
    # the slot of a row is never NULL; said by coalesce, as a filter would part ``counted``'s readers
    passing = (totals.where(F.col("total") >= F.coalesce("least", F.lit(0)))
               .select(F.coalesce("slot", F.lit(0)).alias("slot")).distinct())

    counts = (rows.withColumn("slot", slot).join(F.broadcast(passing), "slot", "left_semi")
              .groupBy(*gs, "key").agg(F.count(F.lit(1)).alias("n")))
    out = weighted(counts)
    if gs:
        out = out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    else:
        out = out.orderBy(F.desc("n"), "key", *xs).limit(k)
    return out.select(*[F.col(inside[c]).alias(c) for c in names], big("n").alias("n"))
