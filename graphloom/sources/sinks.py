"""Writers of graphs, and measures of intermediate results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, undirected


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """``value``: one line ``id 0 n1 n2 ...`` per source, neighbours distinct and ascending."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("n"))
    return lists.select(F.concat_ws(" ", F.col("src").cast("string"), F.lit("0"), F.transform("n", lambda x: x.cast("string"))).alias("value"))


def write_adjacency(edges: DataFrame, path: str) -> None:
    """``adjacency_lines`` as text files."""
    adjacency_lines(edges).write.text(path)


def dimacs_lines(graph: Graph) -> DataFrame:
    """``value``: the graph as DIMACS lines in order; ids must be 1 .. N. Undirected edges stand once."""
    pairs = undirected(graph.edges)
    n, m = graph.vertices.count(), pairs.count()
    spark = graph.edges.sparkSession
    head = spark.range(1).select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(f"p edge {n} {m}").alias("value"))
    colours = graph.vertices.select(F.lit(1), "id", F.lit(0).cast("long"), F.concat_ws(" ", F.lit("n"), F.col("id").cast("string"), F.col("label").cast("string")))
    edges = pairs.select(F.lit(2), "lo", "hi", F.concat_ws(" ", F.lit("e"), F.col("lo").cast("string"), F.col("hi").cast("string")))
    return head.union(colours).union(edges).orderBy("o", "a", "b").select("value")


def dot_lines(graph: Graph) -> DataFrame:
    """``value``: the graph as lines of an undirected dot file, in order."""
    spark = graph.edges.sparkSession
    ends = spark.createDataFrame([(0, 0, 0, "graph g {"), (3, 0, 0, "}")], "o int, a long, b long, value string")
    nodes = graph.vertices.select(F.lit(1), "id", F.lit(0).cast("long"), F.format_string('v%d [label="%d:%d"];', "id", "id", "label"))
    edges = undirected(graph.edges).select(F.lit(2), "lo", "hi", F.format_string("v%d -- v%d;", "lo", "hi"))
    return ends.union(nodes).union(edges).orderBy("o", "a", "b").select("value")


def stage_metrics(stages: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """``stage, level, n_rows`` of named intermediate results, counted in one plan."""
    out = None
    for (stage, level), df in stages.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(stage).alias("stage"), F.lit(level).alias("level"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
