import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.leaks import WuManber, build, leaked_items

A = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, A), (2, "Short item, 3 words"), (3, "zero zero " + A), (4, None), (5, ""), (6, "—!"), (7, "Straße am Нил"), (8, "Short item, 3 words"), (9, "three four")]
DOCS = [
    (1, f"before {A.upper()} after", {1, 3, 9}),
    (2, "x ONE, two; three. four five six seven eight nine\u00a0ten", {1, 3, 9}),
    (3, "one two three four five six seven eight nine", {9}),
    (4, "short-item 3 WORDS", {2, 8}),
    (5, "short item 3 wordss", set()),
    (6, "ｔｗｏ thrее four fi\u200bve six seven eight nine ten eleven", {1, 3, 9}),
    (7, "STRASSE AM НИЛ", {7}),
    (8, "straße am нил und so weiter", {7}),
    (9, None, set()),
    (10, "", set()),
    (11, "two three four five six seven eight nine ten eleven " * 20_000 + "short item 3 words", {1, 2, 3, 8, 9}),
    (12, "zero zero one two three four five six seven", {9}),
]


@pytest.mark.parametrize("block_words", [1, 15, 10**6])
def test_cases(spark, block_words):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = leaked_items(docs, items, "doc_id", "text", "item_id", "text", block_words=block_words)
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, _, s in DOCS for i in s)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(docs, items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_items(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id"), "doc_id", "text", "item_id", "text").count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 10])
def test_search_against_brute_force(n):
    rng = random.Random(n)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    searchers = build(items, n)
    for _ in range(300):
        words = [word() for _ in range(rng.randrange(0, 40))]
        grams = {tuple(words[i : i + k]) for k in range(1, 15) for i in range(len(words) - k + 1)}
        want = set()
        for i, key in items:
            w = tuple(key.split(" "))
            parts = [w[k : k + n] for k in range(len(w) - n + 1)] or [w]
            if any(p in grams for p in parts):
                want.add(i)
        got = set()
        for s in searchers:
            got |= s.find(words)
        assert got == want


def test_shifts_skip_blocks():
    s = WuManber({tuple(f"w{i}" for i in range(10)): ("x",)})
    assert s.m == 10 and s.shift[("w8", "w9")] == 0 and s.shift[("w0", "w1")] == 8
