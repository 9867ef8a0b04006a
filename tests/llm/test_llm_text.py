"""Substring dedup and line dedup against brute force; rolling hashes."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame, odd_rows, words

from tradelens.llm import line_dedup, substring_dedup
from tradelens.llm.rolling import BASES, Windows, covered, spans


@pytest.mark.parametrize("period", [2, 5, 7, 13, 21, 25, 31])
def test_difference_covers(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_rolling_hashes_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    items[200:240] = items[10:50]
    hashes = Windows(BASES[0]).hashes(items, 20)
    equal = {(i, j) for i in range(281) for j in range(i) if hashes[i] == hashes[j]}
    assert equal == {(200 + k, 10 + k) for k in range(21)}
    assert len(Windows(BASES[1]).hashes(items[:5], 20)) == 0


def test_covered_and_spans():
    mask = covered(np.array([-2, 5, 6, 18]), 4, 20)
    assert np.flatnonzero(mask).tolist() == [0, 1, 5, 6, 7, 8, 9, 18, 19]
    assert spans(mask) == [(0, 2), (5, 5), (18, 2)]


def brute_substrings(rows, window):
    first = {}
    lists = [substring_dedup.word_list(t) for _, t in rows]
    for (doc_id, _), w in zip(rows, lists):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if doc_id is not None:
                first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i:i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def passages(rng, window):
    """Documents that share passages of just under, at and over the window, at all
    alignments, some of them shared in part with a third document."""
    rows, next_id = [], 200
    for _ in range(25):
        passage = words(rng, window + rng.choice([-1, 0, 1, 7, 40]), 10_000)
        for _ in range(rng.randrange(2, 5)):
            part = passage if rng.random() < .7 else passage[:rng.randrange(1, len(passage))]
            rows.append((next_id, " ".join(words(rng, rng.randrange(60), 10_000) + part + words(rng, rng.randrange(60), 10_000))))
            next_id += 1
    return rows


@pytest.mark.parametrize("limit", [4_000_000, 0])
@pytest.mark.parametrize("window", [50, 12])
def test_substrings_against_all_windows(spark, window, limit):
    rng = random.Random(window)
    rows = odd_rows(rng) + passages(rng, window)
    rng.shuffle(rows)
    got = substring_dedup.remove_repeats(docs_frame(spark, rows), window, broadcast_limit=limit).collect()
    found = [(r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept_text) for r in got]
    assert sorted(found, key=str) == brute_substrings(rows, window)
    assert any(f[2] for f in found)


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(docs_frame(spark, [])).collect() == []


def test_a_passage_in_every_document(spark):
    rng = random.Random(9)
    shared = " ".join(words(rng, 60))
    rows = [(i, f"{' '.join(words(rng, 20, 10 ** 6))} {shared}") for i in range(300)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_frame(spark, rows)).collect()}
    assert not got[0].removed and all(got[i].removed[0].length == 60 for i in range(1, 300))


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 4, 200).astype(np.uint64)
    at = set(line_dedup.winnowed(hashes, 3).tolist())
    assert all({i, i + 1, i + 2} & at for i in range(198))


def brute_lines(rows, run):
    seen, out = {}, []
    distinct = list(dict.fromkeys((d, t or "") for d, t in rows))
    order = {}
    lists = {t: line_dedup.line_list(t) for _, t in distinct}
    for doc_id, text in distinct:
        if doc_id is not None:
            for i in range(len(lists[text]) - run + 1):
                k = tuple(lists[text][i:i + run])
                seen[k] = min(seen.get(k, (doc_id, i)), (doc_id, i))
    for doc_id, text in [(d, t or "") for d, t in rows]:
        lines, gone = lists[text], set()
        for i in range(len(lines) - run + 1):
            if doc_id is not None:
                d, p = seen[tuple(lines[i:i + run])]
                if d < doc_id or i >= p + run:
                    gone.update(range(i, i + run))
        out.append((doc_id, len(lines), len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run,gram", [(3, 2), (5, 2), (1, 1), (4, 4)])
def test_lines_against_all_windows(spark, run, gram):
    rng = random.Random(run)
    rows = [r for r in odd_rows(rng) if r != (7, "another text of a used id")]
    for i in range(60):
        rows.append((300 + i, "\n".join(f"line {rng.randrange(6)}" for _ in range(rng.randrange(30)))))
    rows.append((999, "\n".join(["a", "b", "c"] * 40)))
    got = line_dedup.remove_repeated_lines(docs_frame(spark, rows), run, gram).collect()
    found = [(r.doc_id, r.n_lines, sum(s.length for s in r.removed), r.kept_text) for r in got]
    assert sorted(found, key=str) == brute_lines(rows, run)


def test_lines_of_an_empty_table_and_a_frequent_block(spark):
    assert line_dedup.remove_repeated_lines(docs_frame(spark, [])).collect() == []
    rows = [(i, f"own {i}\nx\ny\nz\nlast {i}") for i in range(200)]
    got = line_dedup.remove_repeated_lines(docs_frame(spark, rows)).collect()
    assert Counter(sum(s.length for s in r.removed) for r in got) == {0: 1, 3: 199}


def brute_single_lines(rows, least):
    """Of rows with distinct ids: (doc_id, line numbers) that go as long or adjacent lines."""
    seen, gone = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone[doc_id] = set()
        for k, line in enumerate(lines):
            if not line.strip(" \t\n\v\f\r"):
                continue
            if k and lines[k - 1] == line:
                gone[doc_id].add(k)
            if len(line) >= least:
                if line in seen:
                    gone[doc_id].add(k)
                seen.add(line)
    return gone


def test_long_and_adjacent_lines_go(spark):
    rng = random.Random(61)
    pool = ["", "  ", " " * 50, "ab", "ééééééééé", "exactly ten", "a long line that comes often", "another long one, é", "x" * 9, "y" * 10]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {k}" for k in range(rng.randrange(9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "ab\nab\nab\n\n\n\nab"), (103, "z" * 100_000 + "\nq"), (104, "q\n" + "z" * 100_000),
             (105, "s1\ns2\ns3"), (106, "t\ns1\ns2\ns3\n\n")]
    gone = brute_single_lines(rows, 10)
    runs = {d: set() for d, _ in rows}
    for r in line_dedup.remove_repeated_lines(docs_frame(spark, rows), 3, 2).collect():
        for s in r.removed:
            runs[r.doc_id] |= set(range(s.start, s.start + s.length))
    assert any(runs.values()) and any(gone.values())
    for r in line_dedup.remove_repeated_lines(docs_frame(spark, rows + [(None, "ab\nab\nexactly ten")]), 3, 2, long_line=10).collect():
        if r.doc_id is None:
            assert r.kept_text == "ab\nexactly ten"
            continue
        text = dict(rows)[r.doc_id]
        want = gone[r.doc_id] | runs[r.doc_id]
        got = {k for s in r.removed for k in range(s.start, s.start + s.length)}
        assert got == (want if text else set()), r.doc_id
        assert r.kept_text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want) if text else r.kept_text == ""
