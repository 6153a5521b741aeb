"""Text readers of graphs: edge lists, labelled adjacency lists, DIMACS files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph


#: A decimal number; the cast alone would take more, such as a suffix for its type.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Ids sparser than one in so many are not filled up to a whole range unless told to.
SPARSE = 64


def parse_edge_list(lines: DataFrame, weighted: bool = False, drop_self_loops: bool = True) -> DataFrame:
    """``src, dst[, weight]`` of lines ``value``: fields divided by tabs, commas or blanks.

    Lines that begin with # or % and lines without two integers are left out. A
    third field is read as the weight, null where it is missing or no finite decimal number.
    Duplicates and direction are kept. Works on a stream as well as on a table.
    """
    kept = lines.where(F.col("value").isNotNull() & ~F.col("value").rlike("^[#%]"))
    f = F.split(F.trim(F.regexp_replace("value", r"[\t, \r]+", " ")), " ")
    columns = [F.when(F.get("_f", F.lit(i)).rlike("^[+-]?[0-9]+$"), F.get("_f", F.lit(i))).try_cast("long").alias(n) for i, n in enumerate(("src", "dst"))]
    if weighted:
        weight = F.when(F.get("_f", F.lit(2)).rlike(NUMBER), F.get("_f", F.lit(2))).try_cast("float")
        columns.append(F.when(F.abs(weight) < F.lit(float("inf")), weight).alias("weight"))
    edges = kept.select(f.alias("_f")).select(*columns).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return edges.where(F.col("src") != F.col("dst")) if drop_self_loops else edges


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, shift: bool = True, drop_self_loops: bool = True) -> Graph:
    """An edge-list file as a graph. With ``shift`` ids begin at 0, self-loops counted for the smallest id."""
    edges = parse_edge_list(spark.read.text(path), weighted, drop_self_loops=False)
    graph = Graph(edges)
    graph = graph.shift_ids() if shift else graph
    return Graph(graph.edges.where(F.col("src") != F.col("dst"))) if drop_self_loops else graph


def read_adjacency(spark: SparkSession, path: str, edge_labels: bool = False, wrap_labels: bool = True, shift: bool = True, fill_gaps: bool | None = None) -> Graph:
    """Labelled adjacency lists ``id label n1 n2 ...``, by tabs or blanks.

    Neighbours are distinct within their line, self-loops go, ids in gaps get label 0.
    With ``edge_labels`` each neighbour is followed by the label of its edge, which comes
    out as column ``edge_label``. A missing line end at the end of the file loses nothing.
    Shifted ids without a line get a vertex unless ``fill_gaps`` is false; if it isn't said, they do where the ids span
    at most SPARSE times as many as there are vertices.
    """
    f = F.transform(F.split(F.trim(F.regexp_replace("value", r"[\t \r]+", " ")), " "), lambda x: x.try_cast("long"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f")).where(F.size("f") >= 2)
    rows = rows.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("label"), F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))).alias("rest"))
    if edge_labels:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("rest") - 2, F.lit(0))), lambda i: (i % 2 == 0) & (F.size("rest") > 1))
        pairs = rows.select("id", F.explode(F.transform(at, lambda i: F.struct(F.get("rest", i).alias("n"), F.get("rest", i + 1).cast("int").alias("e")))).alias("p"))
        edges = pairs.select(F.col("id").alias("src"), F.col("p.n").alias("dst"), F.col("p.e").alias("edge_label")).where(F.col("src") != F.col("dst"))
        edges = edges.groupBy("src", "dst").agg(F.min("edge_label").alias("edge_label"))
        plain = rows.withColumn("neighbours", F.transform(at, lambda i: F.get("rest", i)))
        graph = Graph(edges, Graph.from_adjacency(plain, wrap_labels=wrap_labels).vertices)
    else:
        graph = Graph.from_adjacency(rows.withColumnRenamed("rest", "neighbours"), wrap_labels=wrap_labels)
    least = F.col("id") if edge_labels else F.least("id", F.coalesce(F.array_min("rest"), "id"))
    low = rows.agg(F.min(least)).first()[0]
    if not shift or not low:
        low = 0
    top = graph.vertices.agg(F.max("id")).first()[0]
    known = graph.vertices.withColumn("id", F.col("id") - low)
    span = (top - low + 1) if top is not None else 0
    fill = shift and (span <= SPARSE * graph.vertices.count() if fill_gaps is None else fill_gaps)
    gaps = spark.range(0, span).join(known, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label")) if fill else known
    return Graph(graph.edges.withColumns({"src": F.col("src") - low, "dst": F.col("dst") - low}), gaps)


def read_dimacs(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """A DIMACS graph: ``c`` comments, ``p edge N M``, ``n v colour``, ``e u v``; ids from 1.

    Vertices 1 .. N with their colour (0 unless told) as ``label``. An undirected
    file's edges come out in both directions.
    """
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(f.alias("f"))
    head = lines.where(F.col("f")[0] == "p").select(F.get("f", F.lit(2)).cast("long")).first()
    if head is None:
        raise ValueError("no problem line (p edge N M)")
    colours = lines.where(F.col("f")[0] == "n").select(F.get("f", F.lit(1)).cast("long").alias("id"), F.get("f", F.lit(2)).cast("int").alias("label"))
    colours = colours.groupBy("id").agg(F.max("label").alias("label"))
    vertices = spark.range(1, head[0] + 1).join(colours, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"))
    edges = lines.where(F.col("f")[0] == "e").select(F.get("f", F.lit(1)).cast("long").alias("src"), F.get("f", F.lit(2)).cast("long").alias("dst"))
    graph = Graph(edges.distinct(), vertices)
    return graph if directed else Graph(graph.symmetrize().edges.distinct(), vertices)
