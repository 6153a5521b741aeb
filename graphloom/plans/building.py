"""Subgraphs of up to three vertices, all of them built (see operators.threes), with what is frequent among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import mining, threes
from graphloom.operators.patterns import with_patterns
from graphloom.plans.counting import labelled_table
from graphloom.runtime import Workspace

Levels = dict[int, tuple[DataFrame, DataFrame]]


def motif_levels(graph: Graph, top: int) -> dict[int, DataFrame]:
    """The connected subgraphs of 2 .. ``top`` edges on at most three vertices as tuples, each once."""
    work = Workspace(graph.edges.sparkSession, "threes")
    edges = labelled_table(graph, work)
    out = {2: threes.wedge_tuples(threes.wedges(edges))}
    if top >= 3:
        out[3] = threes.triangle_tuples(threes.triangles(edges, work))
    return out | {n: out[2].where(F.lit(False)) for n in range(4, top + 1)}


def _sorted(*names: str) -> list[Column]:
    x = F.sort_array(F.array(*names))
    return [x[i] for i in range(len(names))]


def frequent_subgraphs(graph: Graph, support: int, mode: str, levels: int, filter_last: bool) -> Levels:
    """``plans.algorithms.frequent_subgraphs`` for at most three vertices.

    Whether a subgraph is a candidate is told by its labels (and in ``parity`` by its numbering too), so subgraphs are
    counted as they are built, by label, and only classes are written.
    """
    work = Workspace(graph.edges.sparkSession, "frequent3")
    edges = labelled_table(graph, work)
    low, high = F.least("src_label", "dst_label"), F.greatest("src_label", "dst_label")
    out: Levels = {}

    def put(n: int, counts: DataFrame, quick: Column, found: DataFrame, by: dict[str, Column], tuples: object) -> DataFrame:
        """``counts``: classes by the columns ``by`` with their support; returns those that are kept."""
        every = n == levels and not filter_last
        classes = work.cut(counts if every else counts.where(F.col("support") >= support))
        kept = found if every else found.withColumns(by).join(classes.select(*by), [*by], "left_semi")
        out[n] = (with_patterns(classes.select(quick.alias("quick"), "support")), tuples(kept))
        return classes

    once = edges.where(F.col("src") < F.col("dst"))
    of = {"l0": low, "l1": high}
    links = put(1, once.groupBy(low.alias("l0"), high.alias("l1")).agg(F.count("*").alias("support")), F.concat(F.lit("1,2|0,0|"), F.concat_ws(",", "l0", "l1")), once, of, mining.init)
    if levels >= 2:
        ok = F.broadcast(links.select("l0", "l1", F.lit(True).alias("ok")))
        near = work.cut(edges.withColumns(of).join(ok, ["l0", "l1"], "left").select("src", "dst", "src_label", "dst_label", F.coalesce("ok", F.lit(False)).alias("ok")))
        # In parity a tuple grows from its first edge, that of the smaller end.
        found = threes.wedges(near).where(F.col("ok_a") if mode == "parity" else F.col("ok_a") | F.col("ok_b"))
        of = {"x": F.least("la", "lb"), "y": F.greatest("la", "lb")}
        counts = found.groupBy(F.col("lk"), *[c.alias(x) for x, c in of.items()]).agg(F.count("*").alias("support"))
        wedges = put(2, counts, F.concat(F.lit("1,2,3|0,0,0|"), F.concat_ws(",", "lk", "x", "y")), found, {"lk": F.col("lk")} | of, threes.wedge_tuples)
    if levels >= 3:
        found = work.cut(threes.triangles(edges, work))
        if mode == "parity":
            # The tuple of a triangle grows from the wedge at its least vertex.
            of = {"lk": F.col("la"), "x": F.least("lb", "lc"), "y": F.greatest("lb", "lc"), "l0": F.least("la", "lb"), "l1": F.greatest("la", "lb")}
            found = found.withColumns(of).join(F.broadcast(links.select("l0", "l1")), ["l0", "l1"], "left_semi").join(wedges.select("lk", "x", "y"), ["lk", "x", "y"], "left_semi")
        else:
            corners = [F.struct(F.col(k).alias("lk"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y")) for k, x, y in (("la", "lb", "lc"), ("lb", "la", "lc"), ("lc", "la", "lb"))]
            sorts = found.select("la", "lb", "lc").distinct().withColumn("w", F.explode(F.array(*corners))).select("la", "lb", "lc", "w.*")
            met = sorts.join(wedges.select("lk", "x", "y"), ["lk", "x", "y"], "left_semi").select("la", "lb", "lc").distinct()
            found = found.join(met, ["la", "lb", "lc"], "left_semi")
        of = dict(zip("xyz", _sorted("la", "lb", "lc"), strict=True))
        counts = found.groupBy(*[c.alias(x) for x, c in of.items()]).agg(F.count("*").alias("support"))
        put(3, counts, F.concat(F.lit("1,2,3,1|0,0,1,2|"), F.concat_ws(",", "x", "y", "z", "x")), found, of, threes.triangle_tuples)
    none = out[1][0].where(F.lit(False)), out[1][1].where(F.lit(False))
    return {n: out.get(n, none) for n in range(1, levels + 1)}
