"""Cross-tokenizer alignment against a brute-force version over token offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, docs_frame, odd_rows, words

from tradelens.llm import tokenizer_alignment as ta
from tradelens.llm.catalog import QUERIES, public_vocabulary


def b_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _tokenizers(cache={}):
    if not cache:
        import sentencepiece
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_vocabulary().path)
        t.encode_special_tokens = True
        cache["t"], cache["s"] = t, sentencepiece.SentencePieceProcessor(model_file=b_path())
    return cache["t"], cache["s"]


def _printable():
    """The byte-level alphabet, from its published rule."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def brute(rows):
    """All token pairs by comparing byte ranges."""
    t, s = _tokenizers()
    letters, docs, held = _printable(), [], defaultdict(set)
    for key, (doc_id, text) in enumerate(rows):
        text = text or ""
        whole = (" " + text).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [s.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append((doc_id, 0, 0, None, Counter()))
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((i, at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, k = Counter(), 0
        for i, lo, hi in spans[0]:
            while spans[1][k][2] <= lo:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < hi:
                links[i, spans[1][m][0]] += 1
                m += 1
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, x, _ in own if lo <= x < e) for own in spans))
            lo = e
        docs.append((doc_id, len(a), len(b), groups, links))
        for pair in links:
            held[pair].add(key)
    best = defaultdict(int)
    for (a, _), who in held.items():
        best[a] = max(best[a], len(who))
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        out.append((doc_id, n_a, n_b, len(groups or []), sum(links.values()), sum(n for p, n in links.items() if len(held[p]) == best[p[0]]),
                    sum(n * len(held[p]) for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    pairs = Counter()
    for *_, links in docs:
        pairs.update(links)
    return sorted(out, key=str), {p: (len(held[p]), n, len(held[p]) == best[p[0]]) for p, n in pairs.items()}


def short_rows():
    rng = random.Random(41)
    rows = [(i, t if t is None or len(t) < 2_000 else t[:2_000]) for i, t in odd_rows(rng)]
    rows += [(50, "▁ a"), (51, "a▁b"), (52, "漢字 と かな"), (53, "😀😀 é"), (54, " lead"), (55, "tail  "), (56, "\t\n\r x"), (57, "<s> </s> <unk> <0x41>"),
             (58, "ﬁ ﬂ ½"), (59, "é combining"), (60, "a b"), (61, "\x00"), (62, "aaaa" * 50), (63, " "), (64, "the the the the the")]
    rows += [(100 + i, "same words again") for i in range(40)]
    return rows + [(200 + i, " ".join(words(rng, rng.randrange(1, 60), 30))) for i in range(60)]


@pytest.mark.parametrize("block", [2_000_000, 50])
def test_alignment_against_brute_force(spark, block):
    rows = short_rows()
    docs, pairs = ta.align(docs_frame(spark, rows).repartition(3), public_vocabulary(), b_path(), block)
    expected, links = brute(rows)
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in docs.collect()), key=str) == expected
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in pairs.collect()} == links


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_tokenizer_alignment"](spark, SF).collect()), key=str) == brute(rows)[0]


def test_long_texts_and_empty_tables(spark):
    rows = [(1, " " * 1_200_000), (2, "word " * 100_000), (3, "x" * 50_000)]
    docs, _ = ta.align(docs_frame(spark, rows), public_vocabulary(), b_path())
    got = {r.doc_id: r for r in docs.collect()}
    assert len(got) == 3 and got[2].n_links >= 100_000 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values())
    docs, pairs = ta.align(docs_frame(spark, []), public_vocabulary(), b_path())
    assert docs.collect() == [] and pairs.collect() == []


def test_bitmaps_hold_what_they_were_given():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(1 << 16, n, replace=False)) for n in (1, 2, 4095, 4096, 30_000, 3)]
    first, n, bits = ta.bitmaps(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    assert n.tolist() == [len(s) for s in sets] and max(len(b.as_py()) for b in bits) == 8192
    rows, docs = ta.members(pa.chunked_array([bits]))
    assert all((docs[rows == k] == s).all() for k, s in enumerate(sets))
