"""A graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Hot, lookup


@dataclass(frozen=True)
class Graph:
    """``edges``: src, dst and any further columns; ``vertices``: id and any further columns, or None.

    Nothing is run by making a graph. Directed; repeated edges count until ``simplify``.
    """

    edges: DataFrame
    vertices: DataFrame | None = None

    @staticmethod
    def from_edges(df: DataFrame, src: str = "src", dst: str = "dst", drop_self_loops: bool = True) -> Graph:
        """An edge table as a graph: rows with a null end are left out, self-loops too unless told otherwise."""
        edges = df.withColumnsRenamed({src: "src", dst: "dst"}) if (src, dst) != ("src", "dst") else df
        edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        return Graph(edges.where(F.col("src") != F.col("dst")) if drop_self_loops else edges)

    @staticmethod
    def from_adjacency(df: DataFrame, id_col: str = "id", label: str = "label", neighbours: str = "neighbours", wrap_labels: bool = True) -> Graph:
        """Labelled adjacency lists as a graph: each list's distinct neighbours but itself.

        A null label counts as 0. With ``wrap_labels`` labels are taken modulo 256, as
        one byte holds them. An id that is listed only as a neighbour, or in a gap, has label 0.
        """
        rows = df.where(F.col(id_col).isNotNull())
        value = F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long"))
        value = (F.pmod(value, F.lit(256)) if wrap_labels else value).cast("int")
        edges = rows.select(F.col(id_col).cast("long").alias("src"), F.explode(F.array_distinct(F.col(neighbours).cast("array<bigint>"))).alias("dst")).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        listed = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(value).alias("label"))
        others = edges.select(F.col("dst").alias("id")).distinct().join(listed, "id", "left_anti").withColumn("label", F.lit(0))
        return Graph(edges, listed.unionByName(others))

    def symmetrize(self) -> Graph:
        """Every edge in both directions; other edge columns go with both."""
        swapped = {"src": "dst", "dst": "src"}
        back = self.edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in self.edges.columns])
        return replace(self, edges=self.edges.unionByName(back))

    def simplify(self) -> Graph:
        """Distinct (src, dst) without self-loops; other edge columns go."""
        return replace(self, edges=self.edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())

    def shift_ids(self) -> Graph:
        """Ids less the smallest id of an edge end, so that they begin at 0."""
        ends = self.edges.agg(F.min(F.least("src", "dst")).alias("low"))
        low = ends.first()["low"] or 0
        edges = self.edges.withColumns({"src": F.col("src") - low, "dst": F.col("dst") - low})
        return Graph(edges, None if self.vertices is None else self.vertices.withColumn("id", F.col("id") - low))

    def ends(self) -> DataFrame:
        """``id`` of every vertex that occurs in an edge."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def dense_ids(self) -> DataFrame:
        """``id`` of the whole range from the least to the greatest id, ids without an edge too."""
        low, high = self.edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        return self.edges.sparkSession.range(low or 0, high + 1 if high is not None else 0)

    def degrees(self) -> DataFrame:
        """``id, degree``: out-degree of every vertex with an out-edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def labelled_edges(self, hot: Hot | None = None) -> DataFrame:
        """``src, dst, src_label, dst_label`` with the labels of the vertices, 0 where there is none, and ``edge_label`` if the edges have one.

        ``hot``: vertices with too many edges for one task (runtime.hot_keys), whose edges aren't shuffled to meet their label.
        """
        labels = self.vertices.select("id", "label")

        def with_label(df: DataFrame, end: str) -> DataFrame:
            return lookup(df, labels.withColumnsRenamed({"id": end, "label": f"{end}_label"}), end, hot, "left").withColumn(f"{end}_label", F.coalesce(F.col(f"{end}_label"), F.lit(0)))

        more = [c for c in ("edge_label",) if c in self.edges.columns]
        return with_label(with_label(self.edges.select("src", "dst", *more), "src"), "dst").select("src", "dst", "src_label", "dst_label", *more)


def undirected(edges: DataFrame) -> DataFrame:
    """``lo, hi`` with lo < hi: each pair of linked vertices once."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
