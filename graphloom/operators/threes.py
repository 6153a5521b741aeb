"""Subgraphs of three vertices, built from plain columns.

All wedges come out of one join of the edges with themselves, each once, and are
handed on as they are built: a reader that counts or filters them needs neither a
table nor a shuffle of them. Triangles are closed from the end of smallest degree,
so that the wedges of hubs are not joined with the edges. ``wedge_tuples`` and
``triangle_tuples`` give the rows that growing by the ordering rule gives (see operators.mining).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.triangles import oriented, triangles_of
from graphloom.runtime import TILE, Workspace, hot_pairs, salted_join


def wedges(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """``key, a, b`` with a < b and the labels ``lk, la, lb``: two edges at ``key``. ``edges``: a written table of src, dst, src_label, dst_label; a column ``ok`` of it goes along as ``ok_a``, ``ok_b``."""
    marks = [c for c in ("ok",) if c in edges.columns]
    one = edges.select(F.col("src").alias("key"), F.col("src_label").alias("lk"), F.col("dst").alias("a"), F.col("dst_label").alias("la"), *[F.col(c).alias(f"{c}_a") for c in marks])
    two = edges.select(F.col("src").alias("key"), F.col("dst").alias("b"), F.col("dst_label").alias("lb"), *[F.col(c).alias(f"{c}_b") for c in marks])
    by = edges.select("src")
    hot = hot_pairs(by, by, "src", tile=tile)
    return salted_join(one, two, "key", hot and hot.on(["key"]), "a", "b").where(F.col("a") < F.col("b"))


def triangles(edges: DataFrame, work: Workspace) -> DataFrame:
    """``a, b, c`` ascending with their labels ``la, lb, lc``: each triangle once. ``edges`` as above."""
    pairs = work.cut(edges.where(F.col("src") < F.col("dst")).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.col("src_label").alias("l_lo"), F.col("dst_label").alias("l_hi")))
    found = triangles_of(work.cut(oriented(pairs).select("a", "b", "l_a", "l_b")), pairs)
    t = F.sort_array(F.array(*[F.struct(F.col(x).alias("v"), F.col(f"l_{x}").alias("l")) for x in "abc"]))
    return found.select(t.alias("t")).select(*[F.col("t")[i][f].alias(n) for i, x in enumerate("abc") for f, n in (("v", x), ("l", f"l{x}"))])


def _pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def wedge_tuples(w: DataFrame) -> DataFrame:
    """Rows of ``wedges`` as tuples of two edges."""
    first = F.col("key") < F.col("a")

    def either(x: Column, y: Column) -> Column:
        return F.when(first, x).otherwise(y)

    key, a, b = F.col("key"), F.col("a"), F.col("b")
    # The least vertex stands first; both begin with the edge of the smaller end.
    return w.select(
        F.array(F.least(key, a), F.greatest(key, a), b).alias("v"), either(F.array(F.lit(0), F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0), F.lit(1))).alias("h"),
        F.array(either(F.col("lk"), F.col("la")), either(F.col("la"), F.col("lk")), "lb").alias("l"), F.array(_pair(key, a), _pair(key, b)).alias("e"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("q"), F.lit(3).alias("n"),
    )


def triangle_tuples(t: DataFrame) -> DataFrame:
    """Rows of ``triangles`` as tuples of three edges."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return t.select(
        F.array(a, b, c, c).alias("v"), F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(1)).alias("h"), F.array("la", "lb", "lc", "lc").alias("l"), F.array(_pair(a, b), _pair(a, c), _pair(b, c)).alias("e"),
        F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(3)).alias("q"), F.lit(3).alias("n"),
    )
