"""Top-k by frequent-items states against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import item, make_roles

from tradelens.operators import products as prod
from tradelens.operators import text_mining
from tradelens.operators.heavy_hitters import top_k


def _ranked(keys, k):
    return sorted(Counter(keys).items(), key=lambda e: (-e[1], e[0] is not None, e[0] or ""))[:k]


def _zipf(rng, n, words):
    return [f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(n)]


def _flat(rng, n, words):
    return [f"w{i % words}" for i in range(n)]


@pytest.mark.parametrize("draw", [_zipf, _flat])
@pytest.mark.parametrize("slots,tracked", [(8192, 4096), (16, 8), (1, 8)])
def test_equals_plain_counting(spark, draw, slots, tracked):
    rng = random.Random(3)
    keys = draw(rng, 5000, 700) + [None] * 40 + ["x" * 400] * 60
    rng.shuffle(keys)
    rows = spark.createDataFrame([(w,) for w in keys], "word string").repartition(5)
    got = [tuple(r) for r in top_k(rows, "word", 7, slots=slots, tracked=tracked).collect()]
    assert got == _ranked(keys, 7)


@pytest.mark.parametrize("slots,tracked", [(8192, 4096), (8, 8)])
def test_groups_small_null_and_hot(spark, slots, tracked):
    rng = random.Random(4)
    rows = ([(1, w) for w in _zipf(rng, 3000, 300)] + [(2, f"w{i}") for i in range(3)]
            + [(None, w) for w in _flat(rng, 400, 100)] + [(3, None)] * 5 + [(1, "hot")] * 2500)
    df = spark.createDataFrame(rows, "key int, n string").repartition(6)  # names the operator uses inside
    got = top_k(df, "n", 5, ["key"], slots=slots, tracked=tracked).toDF("g", "w", "n").collect()
    by_group = {g: sorted(((r.w, r.n) for r in got if r.g == g), key=lambda e: (-e[1], e[0] is not None, e[0] or ""))
                for g in {r.g for r in got}}
    assert by_group == {g: _ranked([w for h, w in rows if h == g], 5) for g in (1, 2, 3, None)}


def test_ties_at_the_cut_are_broken_by_the_key(spark):
    rows = spark.createDataFrame([(i % 50,) for i in range(500)], "id bigint").repartition(3)
    assert [tuple(r) for r in top_k(rows, "id", 4, slots=4, tracked=8).collect()] == [(i, 10) for i in range(4)]


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], "s int, w string")
    assert top_k(empty, "w", 3).collect() == [] and top_k(empty, "w", 3, ["s"]).collect() == []
    with pytest.raises(ValueError):
        top_k(empty, "w", 0)


def _roles(spark, repeated=False):
    rng = random.Random(8)
    items = [item(f"o{i}", f"p{min(int(rng.paretovariate(0.6)), 400)}") for i in range(3000)]
    items += [item("o", "gone")] * 900 + [item("o", None)] * 700  # sold most, but no product
    products = [(f"p{i}", f"c{i % 9}", 100) for i in range(401)]
    if repeated:
        products += [(f"p{i}", f"c{j}", 100) for i in (3, 200) for j in (1, 1, 2)]
    r = make_roles(spark, items=[i[:5] for i in items])
    schema = r.products.schema
    full = [tuple({"product_id": p, "product_category_name": c}.get(f.name) for f in schema) for p, c, _ in products]
    words = [tuple({"product_category_name": f"c{i}", "product_category_name_english": f"C{i}"}.get(f.name)
                   for f in r.translation.schema) for i in range(0, 9, 2)]
    return make_roles(spark, items=items, products=full, translation=words)


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("k", [1, 6, 40, 1000])
def test_most_sold_products_equals_the_sort(spark, repeated, k):
    r = _roles(spark, repeated)
    want = prod.most_sold_products(r.items, r.products, r.translation).limit(k).collect()
    got = prod.top_products(r.items, r.products, r.translation, k).collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in want]


def test_words_equal_the_sort_and_nothing_is_sorted_globally(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 5, None]), " ".join(_letters(w) for w in _zipf(rng, 30, 90))) for _ in range(200)]
    text = spark.createDataFrame(rows, "review_score int, full_review_text string")
    want = text_mining.top_words_by_score(text_mining.word_count_by_score(text, ["wa"]), 6)
    got = text_mining.frequent_words_by_score(text, ["wa"], 6)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    r = _roles(spark)
    for df in (got, prod.top_products(r.items, r.products, r.translation, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"rangepartitioning|Sort \[.*\], true", plan)


def _letters(word):
    return "w" + "".join(chr(97 + int(c)) for c in word[1:])


@pytest.mark.parametrize("groups", [False, True])
def test_a_skewed_table_is_read_three_times_and_nothing_is_crossed(spark, groups):
    rng = random.Random(6)
    keys = ["a"] * 9000 + ["b"] * 7000 + ["c"] * 5000 + [f"k{i}" for i in range(20000)]
    rng.shuffle(keys)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = (spark.createDataFrame([(i % 2, w) for i, w in enumerate(keys)], "g int, w string")
            .mapInArrow(counted, "g int, w string"))
    found = top_k(rows, "w", 2, ["g"] if groups else [])
    assert {r.w for r in found.collect()} == {"a", "b"}
    assert read.value == 3 * len(keys)  # the bound and the slots come from one aggregate
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "NestedLoop" not in final and "Cartesian" not in final
