import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.runtime import Workspace, clear_workspaces, hot_keys, hot_pairs, lookup, salted_join, shared_root, sweep


@pytest.fixture
def left(spark):
    return spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (2, 101), (3, 102), (None, 103), (9, 104)], "k long, v long")


def test_hot_keys(left):
    assert [r.k for r in hot_keys(left, "k", 55, limit=10).table.collect()] == [1]
    assert hot_keys(left, "k", 55) is None


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup(spark, left, how, few, monkeypatch):
    monkeypatch.setattr(runtime, "FEW_HOT", few)
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k long, t string")
    plain = sorted(map(str, left.join(table, "k", how).collect()))
    for limit in (1000, 10, 1):
        hot = hot_keys(left, "k", limit=limit)
        assert (hot is None) == (limit == 1000) and (hot is None or hot.by_bucket == (few == 0))
        assert sorted(map(str, lookup(left, table, "k", hot, how).select("k", "v", "t").collect())) == plain
        named = lookup(left.withColumnRenamed("k", "x"), table.withColumnRenamed("k", "x"), "x", hot, how)
        assert sorted(map(str, named.select(F.col("x").alias("k"), "v", "t").collect())) == plain


@pytest.mark.parametrize("few", [0, 10_000])
def test_salted_join(spark, left, few, monkeypatch):
    monkeypatch.setattr(runtime, "FEW_HOT", few)
    right = spark.createDataFrame([(1, f"a{i}") for i in range(20)] + [(2, "c"), (None, "n")], "k long, t string")
    plain = sorted(map(str, left.join(right, "k").collect()))
    for hot in (None, hot_keys(left, "k", limit=10), hot_pairs(left, right, "k", limit=10), hot_pairs(left, right, "k", tile=4)):
        assert sorted(map(str, salted_join(left, right, "k", hot, "v").select("k", "v", "t").collect())) == plain
    parts = hot_pairs(left, right, "k", tile=4).table.first()
    assert (parts._pl, parts._pr) == (13, 5)


def test_three_thousand_hot_keys(spark):
    left = spark.range(30_000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("v"))
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("t"))
    hot = hot_keys(left, "k", limit=5)
    assert hot.table.count() == 3000
    assert lookup(left, table, "k", hot).where(F.col("t") == F.col("k") * 2).count() == 30_000
    assert salted_join(left, table, "k", hot, "v").where(F.col("t") == F.col("k") * 2).count() == 30_000


def test_several_key_columns(spark, left):
    both = left.withColumn("j", F.col("k") + 1)
    table = spark.createDataFrame([(1, 2, "a"), (2, 3, "b")], "k long, j long, t string")
    hot = hot_keys(both, ["k", "j"], limit=10)
    assert lookup(both, table, ["k", "j"], hot).count() == 52


def test_workspace(spark, left):
    work = Workspace(spark, "test")
    assert work.root.startswith(shared_root(spark))
    cut = work.cut(left)
    assert cut.count() == 55
    work.drop(cut)
    with pytest.raises(Exception, match="(?i)not.*exist|not_found|no such file"):
        cut.collect()
    work.drop(left)
    clear_workspaces(spark)
    assert sweep(spark, 1000.0) == 0
    work.cut(left)
    assert sweep(spark, -1.0) >= 1
