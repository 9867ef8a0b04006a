"""Connected components of an undirected graph given as an edge table.

Alternating large-star / small-star contraction: each round relinks every
node's neighbours to the smallest node it can see, until only stars are left
(a logarithmic number of rounds). Nothing but two numbers per round reaches
the driver. A node of very high degree never meets in one task: the minimum
per node is a partial aggregate, and the join that hands it to the node's
edges has two plainly shuffled inputs (the minima are checkpointed), which
adaptive execution splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node of
    its component. Loops, repeated edges and edges with a null end are ignored."""
    stars = cut(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
                .where("lo < hi").distinct())
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        nearest = cut(both.groupBy("lo").agg(F.min("hi").alias("m"))
                      .select("lo", F.least("lo", "m").alias("m")))
        large = cut(stars.join(nearest, "lo").select(F.col("m").alias("lo"), "hi").distinct())
        lowest = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        relinked = (large.join(lowest, "hi").where("lo <> m")
                    .select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        stars = cut(relinked.unionByName(lowest.select(F.col("m").alias("lo"), "hi")).distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    return (stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
