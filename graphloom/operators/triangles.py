"""Triangles of a simple undirected graph, whatever its hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphloom.operators import blocks
from graphloom.runtime import Workspace, hot_keys, lookup


def oriented(pairs: DataFrame) -> DataFrame:
    """``a, b, da, db`` of ``lo, hi`` from the end of smaller degree (then smaller id), with the degrees.

    No vertex keeps more than about sqrt(2m) edges. Further columns ``x_lo``, ``x_hi`` of the ends go along as ``x_a``, ``x_b``.
    """
    work = Workspace(pairs.sparkSession, "degrees")
    deg = work.cut(pairs.select(F.explode(F.array("lo", "hi")).alias("x")).groupBy("x").agg(F.count("*").alias("d")))
    hot = hot_keys(None, "x", deg.agg(F.sum("d")).first()[0] or 0, deg.withColumnRenamed("d", "n"))
    both = lookup(lookup(pairs, deg.withColumnsRenamed({"x": "lo", "d": "d_lo"}), "lo", hot), deg.withColumnsRenamed({"x": "hi", "d": "d_hi"}), "hi", hot)
    first = (F.col("d_lo") < F.col("d_hi")) | ((F.col("d_lo") == F.col("d_hi")) & (F.col("lo") < F.col("hi")))
    more = [c[:-3] for c in pairs.columns if c.endswith("_lo")]
    ends = {("lo", "hi"): ("a", "b"), ("d_lo", "d_hi"): ("da", "db")} | {(f"{c}_lo", f"{c}_hi"): (f"{c}_a", f"{c}_b") for c in more}
    columns = []
    for (lo, hi), (a, b) in ends.items():
        columns += [F.when(first, F.col(lo)).otherwise(F.col(hi)).alias(a), F.when(first, F.col(hi)).otherwise(F.col(lo)).alias(b)]
    return both.select(*columns)


def triangles_of(out: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each triangle once, from a written ``oriented`` table and its ``lo, hi``: a, b, c with what ``oriented`` knows of each (b < c).

    Edges point to the end of larger degree, so the two-edge paths that are built number at
    most about m sqrt(2m), whatever the hubs; a path is a triangle if its ends are linked.
    """
    other = out.select("a", *[F.col(c).alias({"b": "c", "db": "dc"}.get(c, c[:-1] + "c")) for c in out.columns if c.endswith("b")])
    path = out.join(other, "a").where(F.col("b") < F.col("c"))
    return path.join(pairs.select(F.col("lo").alias("b"), F.col("hi").alias("c")), ["b", "c"], "left_semi")


def undirected_triangles(pairs: DataFrame) -> DataFrame:
    """``a, b, c`` ascending: each triangle of ``lo, hi`` once. Of whole numbers they are met in tasks (see operators.blocks), and no paths are shuffled."""
    work = Workspace(pairs.sparkSession, "triangles")
    pairs = work.cut(pairs.select("lo", "hi"))
    kinds = {f.name: f.dataType for f in pairs.schema}
    if all(isinstance(kinds[x], IntegralType) for x in ("lo", "hi")):
        return blocks.triangles(pairs).select(*[F.col(x).cast(kinds["lo"]) for x in "abc"])
    met = triangles_of(work.cut(oriented(pairs).select("a", "b")), pairs)
    return met.select(F.sort_array(F.array("a", "b", "c")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
