"""Small document tables with everything that may go wrong."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"

# Names the operators use inside, as columns of the input.
CLASHING = ["key", "id", "n", "row", "fp", "first_id", "component_id", "hash", "pos", "start", "window", "w", "tk", "at",
            "text_key", "rank", "length", "chunk", "lang_pred", "score", "cell", "depth", "bytes", "doc_words", "item_id",
            "__gone", "__leaked", "found"]


def docs_frame(spark, rows, clashing=True):
    """Rows (doc_id, text[, lang]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clashing:
        df = df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls, empties, repeats, ties, white space of all kinds, a very long text."""
    base = " ".join(words(rng, 120))
    long = " ".join(words(rng, 30_000, 5_000))
    return [(1, None), (2, ""), (3, base), (4, base), (4, base), (5, base + " tail"), (None, base), (None, None),
            (6, "  lead\tand\ntrail \n"), (7, "é à ü   x y"), (8, long), (9, long + " end"), (10, "one"),
            (11, "<|endoftext|> \\ </s>[INST]"), (12, "\n\n\n\n"), (7, "another text of a used id")]


def brute_components(fps: dict, distance: int) -> dict:
    """{row: smallest row reachable} by comparing all pairs."""
    rows, parent = sorted(fps), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {r: find(r) for r in rows}
