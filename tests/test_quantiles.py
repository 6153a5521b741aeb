import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators.quantiles import per_key_quantiles

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def brute(rows, probs, share):
    out, total = {}, sum(k is not None for k, _ in rows)
    for key in {k for k, _ in rows if k is not None}:
        every = [v for k, v in rows if k == key]
        held = sorted(v for v in every if v is not None)
        q = [held[max(1, math.ceil(p * len(held))) - 1] if held else None for p in probs]
        out[key] = (len(every), len(held), len(every) > share * total, *q)
    return out


def got(df, key="k"):
    return {r[key]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("spread", [1, 3, 300, 10**6, 2**50, 2**63 - 1])
@pytest.mark.parametrize("large_bins", [False, True])
def test_against_brute_force(spark, spread, large_bins):
    rng = random.Random(spread)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, *range(3, 40)]), rng.choice([None, *[rng.randint(-spread, spread) for _ in range(9)]])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k long, v long")
    more = {"limit": 2} if large_bins else {}  # every open bin counts as hot
    assert got(per_key_quantiles(df, "k", "v", PROBS, 0.1, **more)) == brute(rows, PROBS, 0.1)


def test_ties_repeated_rows_and_other_columns(spark):
    rows = [("a", 5)] * 50 + [("b", 7)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("_c", F.lit(1)).withColumn("n_rows", F.lit("x")).withColumn("hot", F.lit(0))
    assert got(per_key_quantiles(df, "k", "v", (0.5,), 0.5)) == {"a": (50, 50, True, 5), "b": (1, 1, False, 7)}


def test_empty_and_all_null(spark):
    assert per_key_quantiles(spark.createDataFrame([], "k long, v long"), "k", "v").count() == 0
    df = spark.createDataFrame([(1, None), (None, 3)], "k long, v long")
    assert got(per_key_quantiles(df, "k", "v", (0.5,))) == {1: (1, 0, True, None)}


@pytest.mark.parametrize("kind", ["double", "float"])
def test_floats(spark, kind):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, 0.0, -0.0, math.inf, -math.inf, *[rng.uniform(-1, 1) * 2.0 ** rng.randrange(-30, 30) for _ in range(9)]])) for _ in range(800)]
    df = spark.createDataFrame(rows, "k long, v double").withColumn("v", F.col("v").cast(kind))
    rows = [(r.k, r.v) for r in df.collect()]
    assert got(per_key_quantiles(df, "k", "v", PROBS, 0.1)) == brute(rows, PROBS, 0.1)
    odd = spark.createDataFrame([(1, math.nan), (1, 5.0), (1, -0.0)], "k long, v double")
    low, high = got(per_key_quantiles(odd, "k", "v", (0.0, 1.0)))[1][3:]
    assert str(low) == "0.0" and math.isnan(high)


def test_timestamps_and_wrong_types(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, d)) for d in (1, 2, 3)], "k long, v timestamp")
    assert got(per_key_quantiles(df, "k", "v", (0.5,)))[1][3] == 1577923200000000
    with pytest.raises(ValueError):
        per_key_quantiles(spark.createDataFrame([(1, "x")], "k long, v string"), "k", "v")
    with pytest.raises(ValueError):
        per_key_quantiles(df, "k", "v", (1.5,))
