"""Counting tuples by isomorphism class, and keeping those of frequent classes.

Two levels: tuples are counted by their quick pattern (a cheap text, combined
before the shuffle), and only distinct quick patterns get a canonical code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.canonical import automorphisms, code_of_quick, parts_of_code
from graphloom.operators.mining import quick_pattern


def _codes(quicks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for s in quicks:
        for q in s:
            if q not in known:
                known[q] = code_of_quick(q)
        yield s.map(known)


def quick_counts(tuples: DataFrame, labelled: bool) -> DataFrame:
    """``quick, pattern, n``: distinct quick patterns with their class and number of tuples. Labels of edges count if ``labelled`` and there are any."""
    # The arrays that the text is made of are what is counted; the text is made of the distinct ones only.
    edge_labels = labelled and "g" in tuples.columns
    parts = ["q", "h", *(["l"] if labelled else []), *(["g"] if edge_labels else [])]
    counted = tuples.groupBy(*parts).agg(F.count("*").alias("n"))
    counted = counted.select(quick_pattern(labelled, edge_labels).alias("quick"), "n")
    return counted.withColumn("pattern", F.pandas_udf(_codes, T.StringType())(F.col("quick")))


def with_patterns(counts: DataFrame) -> DataFrame:
    """``pattern, n_vertices, n_edges, support`` from ``quick, support`` with one row for each class."""
    return _described(counts.select(F.pandas_udf(_codes, T.StringType())(F.col("quick")).alias("pattern"), "support"))


def sum_patterns(quicks: DataFrame) -> DataFrame:
    """``pattern, n_vertices, n_edges, support`` from ``quick_counts``."""
    return _described(quicks.groupBy("pattern").agg(F.sum("n").alias("support")))


def _described(sums: DataFrame) -> DataFrame:
    labels, edges = F.split(F.split("pattern", r"\|")[0], " "), F.split(F.split("pattern", r"\|")[1], " ")
    return sums.select("pattern", F.size(labels).alias("n_vertices"), F.size(edges).alias("n_edges"), "support")


def count_patterns(tuples: DataFrame, labelled: bool = False) -> DataFrame:
    """``pattern, n_vertices, n_edges, support``: tuples by class; labels count only if ``labelled``."""
    return sum_patterns(quick_counts(tuples, labelled))


def _automorphism_counts(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in codes:
        yield s.map(lambda x: len(automorphisms(*parts_of_code(x)))).astype("int64")


def with_automorphisms(counts: DataFrame) -> DataFrame:
    """``n_automorphisms`` of each ``pattern``."""
    return counts.withColumn("n_automorphisms", F.pandas_udf(_automorphism_counts, T.LongType())(F.col("pattern")))


def keep_frequent(tuples: DataFrame, quicks: DataFrame, support: int, labelled: bool = True) -> DataFrame:
    """The tuples whose class has at least ``support`` tuples.

    Tuples are met by quick pattern, so nothing is worked out for each tuple but its text.
    """
    frequent = quicks.groupBy("pattern").agg(F.sum("n").alias("s")).where(F.col("s") >= support)
    chosen = quicks.join(frequent, "pattern", "left_semi").select("quick")
    return tuples.withColumn("quick", quick_pattern(labelled, labelled and "g" in tuples.columns)).join(chosen, "quick", "left_semi").drop("quick")
