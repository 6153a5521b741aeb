"""Graphs of parts that stand in one order, from the lineitem table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.runtime import Workspace


def part_pairs(spark: SparkSession, sf: str, least_quantity: float = 0.0) -> DataFrame:
    """``src, dst``, symmetric and simple: different parts with a line of at least ``least_quantity`` in one order."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_quantity") >= least_quantity).select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def part_links(spark: SparkSession, sf: str, least_quantity: float = 0.0) -> Graph:
    """The same graph with each link in one direction and once for each order, not written: for programs that reduce edges themselves."""
    # One shuffle, by the order, is all that the join of the lines with themselves needs.
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_quantity") >= least_quantity).select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    return Graph(a.join(b, "l_orderkey").where(F.col("src") < F.col("dst")).select("src", "dst"))


def part_graph(spark: SparkSession, sf: str, least_quantity: float = 0.0) -> Graph:
    """``part_pairs``, written once."""
    return Graph(Workspace(spark, "parts").cut(part_pairs(spark, sf, least_quantity)))
