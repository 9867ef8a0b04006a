"""Benchmark decontamination and license scans against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from helpers import docs_frame, odd_rows, words
from pyspark.sql import functions as F

from tradelens.llm import decontaminate, license_scan

WORD = re.compile(r"[^\W_]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared) if shared else 0.0


def brute_contaminated(rows, items, limit=0.8):
    """{(doc_id, item_id): best similarity} over all item-sized windows."""
    best = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").lower())
        grams = shingles(text)
        for item_id, item in items:
            own = Counter(shingles(item))
            size = len(WORD.findall((item or "").lower()))
            if size < 5 or not own.keys() & set(grams):
                continue
            for start in range(max(len(w) - size, 0) + 1):
                s = similarity(Counter(grams[start:start + size - 4]), own)
                if s >= limit and s > best.get((doc_id, item_id), 0):
                    best[doc_id, item_id] = s
    return best


def benchmark_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns(
        {c: F.lit(1) for c in ("hash", "at", "fp", "n", "w", "doc_id", "block")})


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contaminated_windows_against_all_windows(spark, limit):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.randrange(14, 70), 300))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1]), (104, "a b a b a b a b a b a b a b a b")]
    rows = odd_rows(rng)
    for k in range(80):
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):  # words changed, put in, left out, moved
            at, how = rng.randrange(len(item)), rng.randrange(4)
            item[at:at + 1] = [["x"], [item[at], "y"], [], item[at:at + 1] * 2][how]
        if rng.random() < .2:
            item = item[rng.randrange(4):len(item) - rng.randrange(4)]
        sep = rng.choice([" ", ", ", "\n", "  "])
        rows.append((500 + k, sep.join(words(rng, rng.randrange(50), 300) + [x.upper() for x in item] + words(rng, rng.randrange(50), 300))))
    rows.append((900, items[3][1]))
    rows.append((901, " ".join([items[4][1]] * 5)))
    rows.append((902, "b a " * 30))
    got = decontaminate.contaminated_windows(docs_frame(spark, rows), benchmark_frame(spark, items),
                                             max_broadcast_rows=limit).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(found) == len(got)
    expected = brute_contaminated(rows, items)
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    assert len(found) > 25 and min(found.values()) < 1


def test_clean_documents_stay(spark):
    rng = random.Random(12)
    items = [(1, " ".join(words(rng, 40, 300)))]
    rows = odd_rows(rng) + [(50, "intro " + items[0][1] + " end"), (51, items[0][1][:100])]
    docs = docs_frame(spark, rows)
    kept = decontaminate.keep_clean(docs, benchmark_frame(spark, items))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i != 50)


def test_clean_rows_that_share_an_id_or_have_none_stay(spark):
    item = " ".join(words(random.Random(15), 40, 300))
    rows = [(None, "intro " + item), (None, "a clean text without an id"), (None, None), (7, item), (7, "a clean text of a used id")]
    kept = decontaminate.keep_clean(docs_frame(spark, rows), benchmark_frame(spark, [(1, item)])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)


def test_short_items_are_found(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "the capital of France"), (4, "an item of at least five words"), (5, "...")]
    rows = [(1, "it is PARIS"), (2, "forty, two"), (3, "so the capital of France is Paris"), (4, "two forty the capital"),
            (5, "x an item of at least five words y"), (6, None)]
    got = decontaminate.contaminated_windows(docs_frame(spark, rows), benchmark_frame(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words) for r in got) == [(1, 1, 2, 1), (2, 2, 0, 2), (3, 1, 6, 1), (3, 3, 1, 4), (5, 4, 1, 7)]
    assert {r.similarity for r in got} == {1.0}


def test_decontamination_of_empty_tables(spark):
    rows = [(1, "some words of a text that is long enough")]
    nothing = benchmark_frame(spark, [])
    assert decontaminate.contaminated_windows(docs_frame(spark, rows), nothing).collect() == []
    assert decontaminate.contaminated_windows(docs_frame(spark, []), benchmark_frame(spark, rows)).collect() == []
    assert decontaminate.keep_clean(docs_frame(spark, rows), nothing).count() == 1


@pytest.mark.parametrize("module", [decontaminate, license_scan])
def test_windows_are_counted_before_they_are_broadcast(spark, monkeypatch, module):
    item = " ".join(words(random.Random(16), 20, 300))
    sums = []

    def counted(df, size, limit):
        sums.append((df.count(), df.agg(F.sum(size)).first()[0], limit))
        return df

    monkeypatch.setattr(module, "limited", counted, raising=False)
    docs = docs_frame(spark, [(1, " ".join([item] * 30))])
    if module is decontaminate:
        got = module.contaminated_windows(docs, benchmark_frame(spark, [(1, item)]), max_broadcast_rows=5).collect()
    else:
        got = module.scan(docs, spark.createDataFrame([("a", item)], "template_id string, text string"), max_broadcast_rows=5).collect()
    assert len(got) == 1
    (rows, windows, limit), = sums
    assert rows == 1 and windows > 30 and limit == 5


def test_simhash_and_weighted_jaccard(spark):
    rng = random.Random(13)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(21)]
    row = spark.createDataFrame([(hashes, ["a", "b", "a", "a"], ["a", "c", "a"])], "h array<long>, x array<string>, y array<string>").select(
        decontaminate.simhash(F.col("h")).alias("s"), decontaminate.weighted_jaccard(F.col("x"), F.col("y")).alias("j")).first()
    bits = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > 21)
    assert row.s % (1 << 64) == bits and row.j == 2 / 5


def brute_licenses(rows, templates, limit=0.8):
    """Best containment of a template's shingles in any stretch of the document as
    long as the largest window of its class."""
    found = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").lower())
        for name, notice in templates:
            size = len(WORD.findall(notice.lower()))
            if not size:
                continue
            n, own = min(5, size), set(shingles(notice, min(5, size)))
            grams = shingles(text, n)
            for i in range(len(grams)):
                c = len(own & set(grams[i:i + size - n + 1])) / len(own)
                if c >= limit:
                    found[doc_id, name] = max(c, found.get((doc_id, name), 0))
    return found


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_license_scan(spark, limit):
    rng = random.Random(14)
    templates = [*license_scan.NOTICES.items(), ("short", "Public Domain"), ("none", " ... ")]
    rows = odd_rows(rng)
    for k in range(60):
        notice = rng.choice(templates[:-1])[1].split()
        if rng.random() < .3 and len(notice) > 40:
            notice[rng.randrange(len(notice))] = "changed"
        rows.append((500 + k, " ".join(words(rng, rng.randrange(90)) + notice + words(rng, rng.randrange(90)))))
    rows.append((900, "licensed under the Apache"))
    frame = spark.createDataFrame(templates, "template_id string, text string")
    got = license_scan.scan(docs_frame(spark, rows), frame, max_broadcast_rows=limit).collect()
    found = {(r.doc_id, r.template_id): r.containment for r in got}
    expected = brute_licenses(rows, templates)
    # A window is a little longer than its template, so it may hold more of it than
    # any stretch of the template's own length; it never misses what that holds.
    assert expected.keys() <= found.keys()
    assert all(found[k] >= expected[k] - 1e-12 for k in expected)
    for (doc_id, name), c in found.items():
        text = next(t for i, t in rows if i == doc_id)
        own = set(shingles(dict(templates)[name], min(5, len(WORD.findall(dict(templates)[name])))))
        n = len(next(iter(own)))
        assert c >= 0.8 and len(own & set(shingles(text, n))) / len(own) >= c
    assert len(found) >= 55


def test_license_scan_of_empty_tables(spark):
    templates = license_scan.default_templates(spark)
    assert license_scan.scan(docs_frame(spark, []), templates).collect() == []
    assert license_scan.scan(docs_frame(spark, [(1, "x")]), templates.limit(0)).collect() == []


def test_default_notices_tell_licenses_apart(spark):
    gnu = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU{} General Public "
           "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    bsd = license_scan.NOTICES["BSD-text"]
    lines = [("All rights reserved.", {"All-rights-reserved"}), ("all RIGHTS\nreserved", {"All-rights-reserved"}),
             ("All rights are reserved.", set()), ("Released under the MIT License.", {"MIT"}),
             ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
             ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
             ("GNU Lesser General Public License, version 2.1", {"LGPL-2.1"}), ("GNU Affero General Public License v3.0", {"AGPL-3.0-v"}),
             (gnu.format("", 2), {"GPL-2.0-header"}), (gnu.format("", 3), {"GPL-3.0-header"}),
             (gnu.format(" Lesser", 3), {"LGPL-3.0-header"}), (gnu.format(" Lesser", "2.1"), {"LGPL-2.1-header"}),
             (gnu.format(" Affero", 3), {"AGPL-3.0-header"}), (bsd, {"BSD-text"}),
             ("BSD 2-Clause License " + bsd, {"BSD-2-Clause", "BSD-text"}), ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
             ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}), ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
             ("// SPDX-License-Identifier: GPL-2.0-or-later", {"SPDX-GPL-2.0"}), ("SPDX-License-Identifier: MIT", {"SPDX-MIT"})]
    rows = [(i, f"some words {text} more words") for i, (text, _) in enumerate(lines)]
    templates = license_scan.default_templates(spark)
    for openings in (10_000, 0):
        found = {i: set() for i, _ in rows}
        for r in license_scan.scan(docs_frame(spark, rows), templates, max_openings=openings).collect():
            found[r.doc_id].add(r.template_id)
        assert found == {i: names for i, (_, names) in enumerate(lines)}


def test_every_default_notice_is_found(spark):
    rows = list(enumerate(license_scan.NOTICES.values()))
    got = {(r.doc_id, r.template_id) for r in license_scan.scan(docs_frame(spark, rows), license_scan.default_templates(spark)).collect()}
    assert set(enumerate(license_scan.NOTICES)) <= got
