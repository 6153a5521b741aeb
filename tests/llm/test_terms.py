import random
from collections import Counter

from graphloom.llm.terms import term_counts


def brute(records, rare, common):
    occ, recs = Counter(), Counter()
    for r in records:
        terms = [t for t in (r or []) if t is not None]
        occ.update(terms)
        recs.update(set(terms))
    mark = lambda n: "rare" if n < rare else "common" if n > common * len(records) else None
    return {(t, occ[t], recs[t], mark(recs[t])) for t in occ}


def test_scalar_columns(spark):
    rng = random.Random(1)
    rows = [tuple(rng.choice([None, 0, 0, 0, 1, 1, *range(2, 60)]) for _ in range(2)) for _ in range(800)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "a int, b int, term string, occ int")
    assert set(map(tuple, term_counts(df, ["a", "b"], 5, 0.03).collect())) == brute(rows, 5, 0.03)
    assert set(map(tuple, term_counts(df, ["a"], 5, 0.03).collect())) == brute([r[:1] for r in rows], 5, 0.03)


def test_array_column(spark):
    rng = random.Random(2)
    rows = [None, [], [None], *[[rng.choice("abcdefghij" + "a" * 10) for _ in range(rng.randrange(9))] for _ in range(300)], ["z"] * 50_000]
    df = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    assert set(map(tuple, term_counts(df, ["words"], 2, 0.5).collect())) == brute(rows, 2, 0.5)


def test_empty_and_all_null(spark):
    assert term_counts(spark.createDataFrame([], "a int, b int"), ["a", "b"]).count() == 0
    assert term_counts(spark.createDataFrame([(None, None)], "a int, b int"), ["a", "b"]).count() == 0
