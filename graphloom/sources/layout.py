"""How edge tables are laid out in partitions and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.quantiles import per_key_quantiles


def vertex_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Intervals of equal width over ids low .. high; the last takes the remainder."""
    if parts < 1 or parts > high - low + 1:
        raise ValueError("parts must lie between 1 and the number of ids")
    width = (high - low + 1) // parts
    return [(low + i * width, high if i == parts - 1 else low + (i + 1) * width - 1) for i in range(parts)]


def _part(ranges: list[tuple[int, int]]) -> Column:
    """Number of the interval that holds ``src``."""
    starts = F.array(*[F.lit(a).cast("long") for a, _ in ranges])
    return F.size(F.filter(starts, lambda a: a <= F.col("src"))) - 1


def partition_by_range(edges: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``edges`` with ``part``, by equal id ranges of src, and the ranges."""
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    ranges = vertex_ranges(low, high, parts)
    width = (high - low + 1) // parts
    part = F.least(F.floor((F.col("src") - low) / width).cast("int"), F.lit(parts - 1))
    return edges.withColumn("part", part), ranges


def partition_by_edges(edges: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``edges`` with ``part``, by id ranges of src with about equally many edges, and the ranges.

    The bounds are exact quantiles of src over all edges, by mergeable histograms;
    a vertex is never divided, so a hot one may fill a range alone.
    """
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    ranges = [(low, high)]
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        row = per_key_quantiles(edges.select(F.lit(0).alias("k"), "src"), "k", "src", probs).first()
        bounds = sorted({row[f"q{i}"] for i in range(len(probs))})
        starts = [low, *[b + 1 for b in bounds if b < high]]
        ranges = [(a, (starts[i + 1] - 1) if i + 1 < len(starts) else high) for i, a in enumerate(starts)]
    return edges.withColumn("part", _part(ranges)), ranges


def describe(parted: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """``part, first_id, last_id, n_edges`` of a partitioned edge table."""
    spark = parted.sparkSession
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "part int, first_id long, last_id long")
    counts = parted.groupBy("part").agg(F.count("*").alias("n_edges"))
    return table.join(counts, "part", "left").select("part", "first_id", "last_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def save(graph: Graph, path: str) -> None:
    """The graph as Parquet: ``edges`` clustered by src, and ``vertices`` if there are any."""
    graph.edges.repartitionByRange("src").write.parquet(f"{path}/edges")
    if graph.vertices is not None:
        graph.vertices.write.parquet(f"{path}/vertices")


def load(spark: SparkSession, path: str) -> Graph:
    """A graph written by ``save``; filters on src prune row groups."""
    try:
        vertices = spark.read.parquet(f"{path}/vertices")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        vertices = None
    return Graph(spark.read.parquet(f"{path}/edges"), vertices)
