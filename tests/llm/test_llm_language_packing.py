"""Language identification (held-out accuracy) and packing (exact round trip)."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from helpers import SF, docs_frame, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelens.llm import language_id, packing, tokens
from tradelens.llm.catalog import QUERIES, public_vocabulary


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    tried = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == held(r.doc_id) for r in rows) and len(tried) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in tried) >= 0.95 * len(tried)
    assert all(0 <= r.score <= 1 for r in rows)


def _two_languages(rng):
    a, b = [f"ka{i}to" for i in range(50)], [f"wü{i}ßen" for i in range(50)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(30)), "aa" if i % 2 else "bb") for i in range(80)]
    return [(i, t.translate(str.maketrans("0123456789", "qrstuvwxyz")), lang) for i, t, lang in rows]


def test_languages_of_odd_rows(spark):
    rng = random.Random(21)
    rows = _two_languages(rng) + [(1000 + k, t, None) for k, (_, t) in enumerate(odd_rows(rng))] + [
        (None, "kaqto karto", "aa"), (2000, "12 34 !", "bb"), (2001, "kazzto", "bb"), (2002, "KAQTO", None)]
    got = {}
    for r in language_id.identify(docs_frame(spark, rows)).collect():
        got[r.doc_id] = r
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80])
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0) and got[2000].lang_pred == "und"
    assert got[None].held_out is False and got[None].lang_pred == "aa"
    assert got[2001].lang_pred == "aa" and got[2002].lang_pred == "aa"  # unseen word by its n-grams


def test_labels_of_held_out_rows_and_sources_change_nothing(spark):
    rng = random.Random(22)
    rows = _two_languages(rng)
    other = [(i, t, "aa" if held(i) else lang) for i, t, lang in rows]
    first = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs_frame(spark, rows)).collect()}
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs_frame(spark, other)).collect()}
    assert first == again


def test_nothing_to_learn_from(spark):
    assert language_id.identify(docs_frame(spark, [])).collect() == []
    rows = language_id.identify(docs_frame(spark, [(1, "text"), (2, None)])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_numerals_are_no_letters(spark):
    import regex

    for text in ("½ ② Ⅷ ²", "٣ 12", "ª º", "Ⅷa", "x②y", "漢字", "é", "\u0301"):
        assert language_id.words_of(text) == regex.findall(r"\p{L}+", text.lower()), text
    rows = _two_languages(random.Random(24)) + [(900, "½ ② Ⅷ"), (901, "½ kaqto")]
    got = {r.doc_id: r for r in language_id.identify(docs_frame(spark, rows)).collect()}
    assert (got[900].lang_pred, got[900].score) == ("und", 0.0) and got[901].lang_pred == "aa"


def brute_languages(rows):
    """Plain loops over the definition, without sampling or a bound on words (rows are few)."""
    import math

    import regex

    counts = defaultdict(lambda: defaultdict(int))  # word -> language -> n
    for doc_id, text, lang in rows:
        if lang is not None and not held(doc_id):
            for w in regex.findall(r"\p{L}+", (text or "").lower()):
                counts[w][lang] += 1
    languages = sorted({lang for by in counts.values() for lang in by})
    grams = defaultdict(lambda: defaultdict(int))
    for w, by in counts.items():
        m = f"^{w}$"
        for i in range(len(m)):
            for j in range(i + 1, min(len(m), i + 5) + 1):
                for lang, n in by.items():
                    grams[m[i:j]][lang] += n
    known = {w: by for w, by in counts.items() if sum(by.values()) > 1}

    def logs(table):
        whole = {lang: sum(by.get(lang, 0) for by in table.values()) + 0.1 * len(table) for lang in languages}
        return {k: {lang: math.log((by.get(lang, 0) + 0.1) / whole[lang]) for lang in languages} for k, by in table.items()}

    word_logs, gram_logs = logs(known), {}
    for n in range(1, 6):
        gram_logs.update(logs({g: by for g, by in grams.items() if len(g) == n}))
    memory = {}

    def score(w):
        if w in word_logs:
            return word_logs[w]
        total, m, at = dict.fromkeys(languages, 0.0), f"^{w}$", 0
        while at < len(m):
            found = next((m[at:at + n] for n in range(min(5, len(m) - at), 0, -1) if m[at:at + n] in gram_logs), None)
            for lang in languages:
                total[lang] += gram_logs[found][lang] if found else math.log(1e-7)
            at += len(found) if found else 1
        return total

    out = {}
    for doc_id, text, _ in rows:
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words or not languages:
            out[doc_id] = ("und", 0.0)
            continue
        total = dict.fromkeys(languages, 0.0)
        for w in words:
            if w not in memory:
                memory[w] = score(w)
            for lang in languages:
                total[lang] += memory[w][lang]
        scaled = {lang: t / len(words) * min(len(words), 32) for lang, t in total.items()}
        best = max(languages, key=lambda lang: scaled[lang])
        out[doc_id] = (best, 1 / sum(math.exp(s - scaled[best]) for s in scaled.values()))
    return out


def test_query_against_plain_scorer(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = brute_languages(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op7_language_id"](spark, SF).collect()}
    assert got.keys() == expected.keys()
    assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) < 1e-6 for i in got)


def test_keep_identified(spark):
    rows = _two_languages(random.Random(23)) + [(500, None), (501, "... 1 2"), (502, "", "aa")]
    docs = docs_frame(spark, rows)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))


def test_a_small_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"ka{c}to ka{c}mo" for c in "abcdefghij") * 3, "aa") for i in range(40)]
    rows += [(100 + i, "wüßen zörg", "bb") for i in range(4)]
    model = language_id.fit(docs_frame(spark, rows), max_words=8)
    assert model.languages == ["aa", "bb"] and {"wüßen", "zörg"} <= model.words.keys() and len(model.words) == 8


def test_rows_with_letters_stay_without_labels_or_with_even_odds(spark):
    rows = [(1, "some text"), (2, "12 !"), (3, None)]
    assert [r.doc_id for r in language_id.keep_identified(docs_frame(spark, rows)).collect()] == [1]
    rows = [(i, f"{'abcdef'[i % 6] * 4}", "abcdef"[i % 6]) for i in range(60)] + [(100, "ж"), (101, "7")]
    assert sorted(r.doc_id for r in language_id.keep_identified(docs_frame(spark, rows)).collect()) == [*range(60), 100]


def test_longest_known_ngrams_come_first():
    v = np.array([0.0])
    model = language_id.Model(["a"], {}, {"^ab": v - 3, "b": v - 1, "^": v - 9, "c$": v - 2, "c": v - 20}, v - 100)
    assert model.unseen_word("abc")[0] == -5 and model.unseen_word("bxc")[0] == -9 - 1 - 100 - 2


# ---- packing ----------------------------------------------------------------


@cache
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary().path)


def reference_ids(text):
    return reference().encode(text or "", add_special_tokens=False).ids


alphabet = st.sampled_from([*"aB 7\n\t'é.ßñ-_#", "  ", "'s", " ", "’", "　", "漢", "😀", "<|endoftext|>", "\x1c", "\x85"])


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(alphabet, max_size=30).map("".join))
def test_ids_are_the_tokenizer_files(text):
    got = np.frombuffer(tokens.encoder(public_vocabulary())(text), dtype="<u4").tolist()
    assert got == reference_ids(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a <|endoftext|> b", "<|endoftext|>", "x" + "\t \n" * 400_000 + "y",
                                  "\u2003" * 30_000, "a" * 300_000])
def test_ids_of_long_white_space_and_control_strings(text):
    assert tokens.encoder(public_vocabulary()).ids(text) == reference_ids(text)


def test_control_strings_as_text():
    special = tokens.encoder(public_vocabulary(), special_as_text=True)
    assert 50256 not in special.ids("a <|endoftext|> b") and 50256 in tokens.encoder(public_vocabulary()).ids("a <|endoftext|> b")


def test_one_row_repeated_without_end_is_spread_over_all_chunks(spark):
    docs = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    pieces = packing.pack(docs, public_vocabulary(), 64)
    assert pieces.count() == 40_000 and pieces.select("sequence_id", "offset").distinct().count() == 40_000
    chunks = packing.dealt(packing.pieces(docs, public_vocabulary(), 64), 16).groupBy("chunk").count().collect()
    assert len(chunks) == 16 and max(r["count"] for r in chunks) < 2 * 40_000 / 16


def check_packed(rows, pieces, size):
    """Every id in exactly one piece, sequences gapless and within the size."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    expected = []
    for doc_id, text in rows:
        ids = np.array([*reference_ids(text), 0], dtype="<u4")
        expected += [(doc_id, s, min(size, len(ids) - s), zlib.crc32(ids[s:s + size].tobytes()), len(ids)) for s in range(0, len(ids), size)]
    got = [(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert set(by_seq) == set(range(len(by_seq)))
    return sum(p.length for p in pieces) / (size * len(by_seq)) if pieces else 1.0


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_round_trip(spark, size):
    rng = random.Random(size)
    rows = odd_rows(rng) + [(100 + i, " ".join(words(rng, rng.randrange(60)))) for i in range(200)] + [(400 + i, "same text") for i in range(150)]
    pieces = packing.pack(docs_frame(spark, rows), public_vocabulary(), size).collect()
    check_packed(rows, pieces, size)


def test_packing_the_table_leaves_little_padding(spark):
    pieces = QUERIES["op10_packing"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packed(rows, pieces, 1024) > 0.98


def test_packing_an_empty_table(spark):
    assert packing.pack(docs_frame(spark, []), public_vocabulary()).collect() == []


@settings(max_examples=200, deadline=None, database=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_rank_once(histogram):
    used, taken = defaultdict(set), defaultdict(list)
    for p in packing.places(histogram, 64):
        for r in range(p.count * p.repeat):
            assert p.first + r not in used[p.length]
            used[p.length].add(p.first + r)
            taken[p.base + r // p.repeat].append((p.offset + r % p.repeat * p.length, p.length))
    assert {k: len(v) for k, v in used.items()} == histogram and all(v == set(range(len(v))) for v in used.values())
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
