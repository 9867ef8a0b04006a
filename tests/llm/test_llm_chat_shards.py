"""Chat formatting (round trips, layouts) and sharding (limits, extendible directory)."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
from collections import defaultdict

import pytest
from helpers import docs_frame, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelens.llm import chat_format, sharding

MESSAGES = "id long, messages array<struct<role:string,content:string>>"


def round_trip(spark, conversations):
    df = spark.createDataFrame([(i, [(r, t) for r, t in c]) for i, c in enumerate(conversations)], MESSAGES)
    chat = chat_format.format_chat(df).select(
        "id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("back"),
        chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    return {r.id: r for r in chat.collect()}


pieces = st.lists(st.sampled_from(["\\", "<", "[", "|", "x", "\n", "é", "😀", " ", *chat_format.CONTROL,
                                   *[c[:-1] for c in chat_format.CONTROL], *[c[1:] for c in chat_format.CONTROL]]),
                  max_size=8).map("".join)


@settings(max_examples=8, deadline=None, database=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>\\"]), pieces), max_size=6), min_size=30, max_size=40))
def test_any_text_comes_back(spark, conversations):
    got = round_trip(spark, conversations)
    for i, c in enumerate(conversations):
        r = got[i]
        assert [(t.role, t.text) for t in r.back] == c
        assert r.learned == "".join(t for role, t in c if role == "assistant")
        assert [(r.formatted[s.start:s.start + s.length]) for s in r.loss_spans] == own_escaped(r.formatted)
        marks = [chat_format.START, chat_format.SEPARATOR, chat_format.END]
        assert all(r.formatted.count(m) == len(c) for m in marks)
        # the marks are where turns begin, part and end; between them no control string is left
        parts = [p for turn in r.formatted.split(chat_format.END)[:-1] for p in turn.removeprefix(chat_format.START).split(chat_format.SEPARATOR)]
        assert len(parts) == 2 * len(c) and not any(x in p for x in chat_format.CONTROL for p in parts)


def own_escaped(formatted):
    turns = [t.removeprefix(chat_format.START).split(chat_format.SEPARATOR) for t in formatted.split(chat_format.END)[:-1]]
    return [text for role, text in turns if role == "assistant"]


def test_long_conversations_take_time_in_proportion(spark):
    def run(n):
        one = [("user" if k % 2 else "assistant", f"turn {k} é\\ <s> " + "x" * (k % 70)) for k in range(n)]
        rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 1, 'user', 'assistant') as role",
                                         "concat('turn ', id, ' é\\\\ <s> ', repeat('x', cast(id % 70 as int))) as text")
        began = time.time()
        chat = chat_format.format_chat(chat_format.gathered(rows)).select(
            "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("back"),
            chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
        row = chat.select(F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], t["text"])), ""), 256).alias("back"),
                          F.sha2("learned", 256).alias("learned"), F.size("loss_spans").alias("spans")).first()
        took = time.time() - began
        assert row.spans == (n + 1) // 2
        assert row.learned == hashlib.sha256("".join(t for role, t in one if role == "assistant").encode()).hexdigest()
        assert row.back == hashlib.sha256("".join(r + t for r, t in one).encode()).hexdigest()
        return took

    run(1_000)
    small, large = run(1_000), run(100_000)
    assert large < 100 * max(small, 1.0), (small, large)


@settings(max_examples=5, deadline=None, database=None)
@given(st.lists(st.lists(st.integers(0, 1 << 40), max_size=70), min_size=5, max_size=8))
def test_running_sums(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>")
    got = {r.i: r.s for r in df.select("i", chat_format.running_sums(F.col("x")).alias("s")).collect()}
    assert got == {i: list(itertools.accumulate(x)) for i, x in enumerate(lists)}


def test_layouts_by_fingerprint(spark):
    schema = ("id long, prompt string, response string, instruction string, input string, output string, "
              "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, score double")
    rows = [(1, "p", "r", *[None] * 5, None, 0.5), (2, None, None, "do", None, "done", None, None, None),
            (3, None, None, "do", "it", "done", None, None, None), (4, None, None, None, None, None, [("user", "a"), (None, None)], None, None),
            (5, None, None, None, None, None, None, [("human", "q"), ("gpt", "a")], None), (6,),
            (7, "p", None, None, None, None, None, None, None), (8, *[None] * 5, [], None, None)]
    rows = [tuple(list(r) + [None] * (9 - len(r)))[:9] for r in rows]
    got = {r.id: r for r in chat_format.format_chat(spark.createDataFrame(rows, schema)).collect()}
    turns = {i: [tuple(t) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert turns == {1: [("user", "p"), ("assistant", "r")], 2: [("user", "do"), ("assistant", "done")],
                     3: [("user", "do\nit"), ("assistant", "done")], 4: [("user", "a"), ("", "")],
                     5: [("user", "q"), ("assistant", "a")], 6: None, 7: None, 8: []}
    assert got[1].layout == "prompt_response" and got[5].layout == "conversations" and got[7].formatted is None
    assert got[8].formatted == "" and got[8].loss_spans == []
    assert len({r.fingerprint for r in got.values()}) == 7  # 4 and 8 share theirs


def test_nested_layout_and_own_mapping(spark):
    df = spark.sql("select 1 id, named_struct('ask', named_struct('text', 'q'), 'reply', 'a') data, 'kept' formatted")
    mapping = chat_format.Mapping("nested", ("data.ask.text", "data.reply"), lambda: F.array(
        F.struct(F.lit("user").alias("role"), F.col("data.ask.text").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.col("data.reply").alias("text"))))
    row = chat_format.format_chat(df, [mapping]).first()
    assert row.layout == "nested" and row.formatted.count(chat_format.START) == 2


def test_gathered_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", None), (1, 1, None, "b"), (None, 0, "user", "x"), (2, None, "user", "y"), (2, 0, "user", "z"),
            (1, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat_format.gathered(df).collect()}
    assert got == {1: [("user", ""), ("", "b"), ("assistant", "c"), ("assistant", "c")], None: [("user", "x")], 2: [("user", "y"), ("user", "z")]}
    assert chat_format.format_chat(chat_format.gathered(df.limit(0))).collect() == []


def _hash(doc_id, text):
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}\u0001{text or ''}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("limit", [300, 5_000, 10 ** 9])
def test_shards_are_the_shortest_prefixes_that_fit(spark, limit):
    rng = random.Random(limit)
    rows = [r for r in odd_rows(rng) if r != (4, odd_rows(rng)[3][1])] + [(100 + i, " ".join(words(rng, rng.randrange(40)))) for i in range(400)]
    rows = list(dict.fromkeys(rows))
    rows = [r for r in rows if len((r[1] or "").encode()) <= limit]
    got = sharding.assign_shards(docs_frame(spark, rows), limit).collect()
    size = defaultdict(int)
    for doc_id, text in rows:
        for d in range(61):
            size[d, _hash(doc_id, text) >> (60 - d)] += len((text or "").encode())
    assert len(got) == len(rows)
    for r in got:
        h = _hash(r.doc_id, r.text)
        depth = next(d for d in range(61) if size[d, h >> (60 - d)] <= limit)
        assert r.shard_id == (format(h >> (60 - depth), f"0{depth}b") if depth else ".")
        assert (r.shard_depth, r.shard_bytes) == (depth, size[depth, h >> (60 - depth)])


def test_shards_of_one_repeated_row_and_of_a_huge_one(spark):
    rows = [(1, "x" * 100)] * 300 + [(i, "y" * 50) for i in range(2, 200)] + [(500, "z" * 5000), (501, ""), (501, "")]
    docs = docs_frame(spark, rows)
    got = sharding.assign_shards(docs, 1000)
    assert set(docs.columns) <= set(got.columns)
    sums, texts = defaultdict(int), defaultdict(set)
    for r in got.collect():
        sums[r.shard_id, r.shard_bytes] += len(r.text)
        texts[r.shard_id].add(r.text)
    assert all(s == b for (_, b), s in sums.items()) and sum(sums.values()) == sum(len(t) for _, t in rows)
    over = [i for (i, _), s in sums.items() if s > 1000]
    assert len(over) == 1 and texts[over[0]] - {""} == {"z" * 5000}
    assert len([i for i in texts if "x" * 100 in texts[i]]) >= 30


def test_sharding_an_empty_table_and_writing(spark, tmp_path):
    assert sharding.assign_shards(docs_frame(spark, []), 100).collect() == []
    rows = [(i, f"text {i} " * 5) for i in range(50)]
    sharding.write_shards(docs_frame(spark, rows, clashing=False), f"file://{tmp_path}/shards", 500)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert back.select("shard_id").distinct().count() > 4


def test_optional_fields_without_a_value_do_not_change_the_layout(spark):
    rows = [(1, [("user", "hi", None), ("assistant", None, None)]), (2, []), (3, [("user", "hi", "Ann")]), (4, None)]
    records = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string,name:string>>")
    got = {r.id: r for r in chat_format.format_chat(records).collect()}
    assert [got[i].layout for i in (1, 2, 3, 4)] == ["messages", "messages", None, None]
    assert [tuple(t) for t in got[1].turns] == [("user", "hi"), ("assistant", "")] and got[2].formatted == ""
