"""Edge lists that keep arriving, as Structured Streaming plans.

The same parser and the same aggregates as for tables; state is kept per vertex, or per
edge within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.text import parse_edge_list


def read_edge_stream(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``src, dst[, weight]`` of edge-list files as they come into a folder."""
    return parse_edge_list(spark.readStream.text(path), weighted)


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: out-degrees so far; write in update or complete mode."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def windowed_degrees(edges: DataFrame, time: str, window: str, lateness: str) -> DataFrame:
    """``start, id, degree`` per window of event time; edges later than ``lateness`` are left out once their window is closed."""
    late = edges.withWatermark(time, lateness)
    counts = late.groupBy(F.window(time, window).alias("w"), F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return counts.select(F.col("w.start").alias("start"), "id", "degree")


def first_deliveries(edges: DataFrame, time: str, lateness: str) -> DataFrame:
    """Each (src, dst, time) once, though rows are delivered again within ``lateness``."""
    return edges.withWatermark(time, lateness).dropDuplicates(["src", "dst", time])
