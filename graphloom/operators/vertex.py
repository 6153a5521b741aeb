"""Scatter and gather over a graph with vertex state, degrees and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph, undirected
from graphloom.runtime import HOT_ROWS, Hot, Workspace, hot_keys, lookup


def scatter(edges: DataFrame, **columns: Column) -> DataFrame:
    """One update for each edge, its columns as named; ``target`` is the key of the update."""
    return edges.select(*[c.alias(n) for n, c in columns.items()])


def scatter_vertices(edges: DataFrame, vertices: DataFrame, hot: Hot | None = None, **columns: Column) -> DataFrame:
    """One update for each edge with the state of its source; edges without a known source give none.

    ``hot``: sources with too many edges for one task (runtime.hot_keys), whose edges are not shuffled.
    """
    return lookup(edges, vertices.withColumnRenamed("id", "src"), "src", hot).select(*[c.alias(n) for n, c in columns.items()])


def scatter_updates(updates: DataFrame, **columns: Column) -> DataFrame:
    """Updates mapped to others, with another key if wanted."""
    return updates.select(*[c.alias(n) for n, c in columns.items()])


def gather(vertices: DataFrame, updates: DataFrame, folds: dict[str, Column], state: dict[str, Column]) -> DataFrame:
    """New vertex state: ``folds`` over each vertex's updates, then ``state`` from old columns and folds.

    Folds must not depend on order; they are combined before the shuffle. Vertices without updates keep their state; an update whose
    target is no vertex is lost.
    """
    folded = updates.groupBy(F.col("target").alias("id")).agg(*[c.alias(n) for n, c in folds.items()], F.lit(True).alias("_got"))
    both = vertices.join(folded, "id", "left")
    return both.select("id", *[(F.when(F.col("_got"), state[c]).otherwise(F.col(c)) if c in state else F.col(c)).alias(c) for c in vertices.columns if c != "id"])


def init_vertices(source: DataFrame | tuple[SparkSession, int], **state: Column) -> DataFrame:
    """Vertex table with initial state, from ids or for ids 0 .. n-1."""
    ids = source[0].range(source[1]) if isinstance(source, tuple) else source.select("id")
    return ids.select("id", *[c.alias(n) for n, c in state.items()])


def with_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` with ``degree``, the out-degree, 0 where there is none."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.drop("degree").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def dense_numbers(ids: DataFrame) -> DataFrame:
    """``id, number``: 0 .. n-1 in ascending order of id.

    Rows are range-partitioned and sorted; the numbers of a partition begin after the
    rows of those before, of which only the counts (one per partition) are collected.
    """
    work = Workspace(ids.sparkSession, "numbers")
    placed = work.cut(ids.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, {}
    for part, n in counts:
        starts[part] = before
        before += n
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    if not starts:
        return placed.select("id", F.lit(0).cast("long").alias("number"))
    start = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))])
    return placed.select("id", (rank + start[F.col("_part")]).cast("long").alias("number"))


def prune_graph(graph: Graph, keep: Column, limit: int = HOT_ROWS) -> Graph:
    """The graph of the vertices for which ``keep`` holds, symmetric, simple and renumbered from 0 by ascending old id.

    Vertices without a kept edge vanish. Vertex columns are kept, with ``old_id``. Edges of a vertex
    with more than ``limit`` of them stay where they are and meet its row by broadcast.
    """
    work = Workspace(graph.edges.sparkSession, "prune")
    kept = graph.vertices.where(keep)
    ids = work.cut(kept.select("id"))
    pairs = work.cut(undirected(graph.edges))
    n = pairs.count()
    hot = {end: hot_keys(pairs, end, n, limit=limit) for end in ("lo", "hi")}
    for end in ("lo", "hi"):
        pairs = lookup(pairs, ids.withColumnRenamed("id", end), end, hot[end])
    pairs = work.cut(pairs)
    numbers = work.cut(dense_numbers(pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()))
    for end, new in (("lo", "_s"), ("hi", "_d")):
        pairs = lookup(pairs, numbers.withColumnsRenamed({"id": end, "number": new}), end, hot[end])
    both = pairs.select(F.explode(F.array(F.struct(F.col("_s").alias("src"), F.col("_d").alias("dst")), F.struct(F.col("_d").alias("src"), F.col("_s").alias("dst")))).alias("e"))
    vertices = kept.join(numbers, "id").withColumnRenamed("id", "old_id").withColumnRenamed("number", "id")
    return Graph(both.select("e.src", "e.dst"), vertices)
