"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import SF, docs_frame, odd_rows

from tradelens.llm import spelling_variants as sv
from tradelens.llm.catalog import QUERIES

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: set() for w in vocabulary}
    holes: dict = {}
    for w in vocabulary:  # two words are near if a hole at one place makes them equal, or one is the other with a hole
        for k in range(len(w)):
            holes.setdefault((len(w), k, w[:k] + w[k + 1:]), []).append(w)
            if w[:k] + w[k + 1:] in vocabulary:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= set(own) - {w}
    forms = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        if best is not None and vocabulary[best] >= 2 * n:
            forms[w] = best
    out = []
    for w, n in vocabulary.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n, len(near[w]), forms.get(w), vocabulary.get(forms.get(w)), root))
    return sorted(out)


def told(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in df.collect())


def small_rows():
    rng = random.Random(51)
    rows = odd_rows(rng)
    letters = "abcdeé×ÿ÷ß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(30)]
    for i in range(300):
        own = []
        for _ in range(rng.randrange(40)):
            w = rng.choice(base[:3] if rng.random() < 0.5 else base)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((1000 + i, rng.choice([" ", "-", "漢", "\n", "1"]).join(own)))
    rows += [(None, "nullid nullid nullid nullib"), (2000, "aaaaa aaaaaa aaaaaaa " * 4 + "aaaaab " * 3), (2001, "z" * 300 + " "), (2002, ("z" * 300 + " ") * 3 + ("z" * 299 + "y ") * 9)]
    return rows


@pytest.mark.parametrize("filter_bytes", [64 << 20, 64])
def test_variants_against_all_pairs(spark, filter_bytes):
    rows = small_rows()
    expected = brute(rows)
    assert told(sv.variants(docs_frame(spark, rows).repartition(3), filter_bytes=filter_bytes)) == expected
    chained = {w: form for w, _, _, form, _, _ in expected if form}
    assert any(form in chained for form in chained.values())  # chains of two and more


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(QUERIES["op11_spelling_variants"](spark, SF)) == brute(rows)


def test_small_tables_count_the_same(spark):
    rows = small_rows()
    docs = docs_frame(spark, rows)
    whole = {r.word: r.n for r in sv.word_counts(docs).collect()}
    assert {r.word: r.n for r in sv.word_counts(docs, table_words=5).collect()} == whole


def test_long_texts_are_cut_at_gaps(monkeypatch):
    monkeypatch.setattr(sv, "WINDOW", 10)
    text = "Wörter mit Lücken und averyveryverylongwordindeed – ein’s ŒUVRE x"
    found = [w.decode("latin-1") for portion in sv.runs(text) for w in portion]
    assert found == [w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_no_words(spark):
    assert sv.variants(docs_frame(spark, [])).collect() == []
    assert sv.variants(docs_frame(spark, [(1, None), (2, ""), (3, "one two")])).collect() == []
