import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.groups import link_groups


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in root)


def shuffled_chain(n):
    ids = random.Random(n).sample(range(10 * n), n)
    return list(zip(ids, ids[1:], strict=False))


CASES = {
    "random": [tuple(random.Random(i).choice([None, *range(400)]) if i % 9 == 0 else random.Random(i * 7 + k).randrange(400) for k in range(2)) for i in range(330)],
    "chain up": [(i, i + 1) for i in range(130)],
    "chain down": [(i + 1, i) for i in range(130)],
    "chain shuffled": shuffled_chain(200),
    "star of the least": [(0, i) for i in range(1, 300)],
    "star of the greatest": [(300, i) for i in range(300)],
    "alone": [(5, 5), (5, 5), (6, 6), (6, 7), (-3, -3)],
    "repeated": [(1, 2), (2, 1), (1, 2), (2, 2), (-9, 2)],
    "nulls": [(None, None), (None, 1), (2, None)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_groups(spark, name):
    df = spark.createDataFrame(CASES[name], "src long, target long").withColumn("c", F.lit(1)).withColumn("group_id", F.lit("x"))
    assert sorted(map(tuple, link_groups(df).collect())) == brute(CASES[name])


@pytest.mark.parametrize("sizes", [{"hot_rows": 3}, {"hot_rows": 3, "small": 0}, {"small": 0}, {"small": 150}])
@pytest.mark.parametrize("name", ["random", "star of the greatest", "chain shuffled"])
def test_hot_vertices_and_distributed_rounds(spark, name, sizes):
    df = spark.createDataFrame(CASES[name], "src long, target long")
    assert sorted(map(tuple, link_groups(df, **sizes).collect())) == brute(CASES[name])


@pytest.mark.parametrize("small", [0, 10**6])
def test_other_ids(spark, small):
    df = spark.createDataFrame([("b", "a"), ("b", "ü"), ("x", "x"), ("é", "z")], "src string, target string")
    assert sorted(map(tuple, link_groups(df, small=small).collect())) == [("a", "a"), ("a", "b"), ("a", "ü"), ("x", "x"), ("z", "z"), ("z", "é")]
