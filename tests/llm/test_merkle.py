import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import merkle
from graphloom.llm.merkle import collapse_copies, digest, edges_of_records, normalised
from graphloom.llm.queries import EDGE

BODIES = [
    (1, "src: Ulmer Bank 007 | target: Björk Löch 12"),
    (2, "TARGET=[björk-löch-12] ; sRc=(ULMER.bank.007)"),
    (3, unicodedata.normalize("NFD", "target: Björk Löch 12, src: Ulmer Bank 007")),
    (4, "src: Ulmer Bank 7 | target: Björk Löch 12"),  # leading zeros count
    (5, "src: Ulmer Bank 007 | target: Bjork Löch 12"),  # accents count
    (6, "target: Ulmer Bank 007 | src: Björk Löch 12"),  # the other way round
    (7, "src: Ulmer Bank 007"),
    (8, "target: x src:"),
    (9, None),
    (10, ""),
    (11, "* src: Ulmer Bank 0,07\ntarget: Björk  L'öch 1-2 "),
    (12, "nothing here"),
    (13, "src: " + "a" * 500_000 + " target: " + "b. " * 100_000),
    (14, "target:" + "b" * 100_000 + " src: " + "A" * 500_000),
    (None, "src: Ulmer Bank 007 | target: Björk Löch 12"),
]


@pytest.mark.parametrize("floor", [1, 10**6])
def test_groups(spark, monkeypatch, floor):
    df = spark.createDataFrame(BODIES, "rec_id long, body string").withColumn("_d", F.lit("clash")).withColumn("copies", F.lit(9))
    got = collapse_copies(edges_of_records(df, "rec_id", "body"), "rec_id", F.col("edge"), EDGE, hot_rows=floor)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1), (5, 5, 1), (6, 6, 1), (11, 1, 4), (13, 13, 2), (14, 13, 2)]


def test_equal_digests_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_hash", lambda tag, body: F.lit("00"))
    df = spark.createDataFrame(BODIES, "rec_id long, body string")
    got = collapse_copies(edges_of_records(df, "rec_id", "body"), "rec_id", F.col("edge"), EDGE)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1), (5, 5, 1), (6, 6, 1), (11, 1, 4), (13, 13, 2), (14, 13, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id long, body string")
    assert collapse_copies(edges_of_records(df, "rec_id", "body"), "rec_id", F.col("edge"), EDGE).count() == 0


def test_nested_digests(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.MapType(T.StringType(), T.IntegerType()))]))), T.StructField("b", T.BinaryType())])
    one = ([("Foo!", {"k": 1, "l": 2}), ("bar", None)], bytearray(b"1"))
    rows = [
        (1, one), (2, ([("BAR", None), ("f-oo", {"L": 2, "k": 1})], bytearray(b"1"))), (3, ([("bar", None), ("foo", {"l": 1, "k": 2})], bytearray(b"1"))),
        (4, ([("bar", None)], bytearray(b"1"))), (5, ([("foo", {"k": 1, "l": 2}), ("bar", None)], bytearray(b"2"))), (6, ([("bar", None), ("bar", None)], bytearray(b"1"))), (7, (None, None)), (8, None),
    ]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("r", kind)]))
    value, plain = normalised(F.col("r"), kind)
    df = df.withColumn("n", value)
    d = {r[0]: r[1] for r in df.select("id", digest(F.col("n"), plain)).collect()}
    assert d[1] == d[2] and len(set(d.values())) == 7
    ordered = {r[0]: r[1] for r in df.select("id", digest(F.col("n"), plain, ordered_arrays=True)).collect()}
    assert ordered[1] != ordered[2]
    got = collapse_copies(df, "id", F.col("r"), kind)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 1, 2), *[(i, i, 1) for i in range(3, 8)]]


def test_numbers_keep_sign_and_point(spark):
    kind = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])
    rows = [(1, (5, 1.5)), (2, (-5, 1.5)), (3, (5, 15.0)), (4, (5, 1.5))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("r", kind)]))
    assert sorted(map(tuple, collapse_copies(df, "id", F.col("r"), kind).collect())) == [(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 2)]


def test_order_of_arrays(spark):
    kind = T.ArrayType(T.StringType())
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["B", "a"]), (3, ["A", "b"])], "i long, r array<string>")
    assert sorted(map(tuple, collapse_copies(df, "i", F.col("r"), kind).collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert sorted(map(tuple, collapse_copies(df, "i", F.col("r"), kind, ordered_arrays=True).collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
