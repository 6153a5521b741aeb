"""Growing connected subgraphs one edge at a time.

A tuple is a row ``v, h, l, e, q, n``: ``v`` the vertices in the order of growth, where a
vertex stands again for each cycle it closes; ``h`` for each position the position it
grew from; ``l`` the labels; ``e`` the edges as struct(lo, hi) in the order of growth; ``q``
the vertices numbered from 1 in the order they appear; ``n`` the number of distinct vertices.
Position j > 0 stands for the edge from ``v[h[j]]`` to ``v[j]``.

Edges of the graph: symmetric ``src, dst, src_label, dst_label``. With a column ``edge_label``
the tuples have a column ``g``, the labels of their edges (null at position 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.vertex import dense_numbers
from graphloom.runtime import HOT_ROWS, TILE, Hot, hot_keys, hot_pairs, lookup, salted_join

COLUMNS = ("v", "h", "l", "e", "q", "n")


def _edge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _labelled(df: DataFrame) -> bool:
    return "edge_label" in df.columns or "g" in df.columns


def init(edges: DataFrame) -> DataFrame:
    """Tuples of one edge, src < dst."""
    more = [F.array(F.lit(None).cast("int"), F.col("edge_label").cast("int")).alias("g")] if _labelled(edges) else []
    return edges.where(F.col("src") < F.col("dst")).select(
        F.array("src", "dst").alias("v"), F.array(F.lit(0), F.lit(0)).alias("h"), F.array("src_label", "dst_label").alias("l"), F.array(_edge(F.col("src"), F.col("dst"))).alias("e"), F.array(F.lit(1), F.lit(2)).alias("q"), F.lit(2).alias("n"), *more
    )


def n_vertices() -> Column:
    """Distinct vertices of a tuple."""
    return F.col("n")


def by_vertex(tuples: DataFrame) -> DataFrame:
    """Each tuple once for each distinct vertex, with ``key`` (the vertex) and ``i`` (its first position)."""
    x = tuples.select("*", F.posexplode("v").alias("i", "key"))
    return x.where(F.array_position("v", F.col("key")) - 1 == F.col("i"))


def _appended(x: DataFrame, w: Column, label: Column, number: Column, n: Column) -> DataFrame:
    more = [F.concat("g", F.array(F.col("edge_label").cast("int"))).alias("g")] if _labelled(x) else []
    return x.select(
        F.concat("v", F.array(w)).alias("v"), F.concat("h", F.array("i")).alias("h"), F.concat("l", F.array(label)).alias("l"), F.concat("e", F.array(_edge(F.col("key"), w))).alias("e"),
        F.concat("q", F.array(number)).alias("q"), n.alias("n"), *more,
    )


def _place(w: Column) -> Column:
    return (F.array_position("v", w) - 1).cast("int")


def hot_vertices(tuples: DataFrame, edges: DataFrame, limit: int = HOT_ROWS, tile: int = TILE) -> Hot | None:
    """Vertices at which ``expand`` would give one task too many tuples, edges or results."""
    return hot_pairs(by_vertex(tuples.select("v")).select("key"), edges.select(F.col("src").alias("key")), "key", limit, tile)


def hot_keyed(keyed: DataFrame, edges: DataFrame, limit: int = HOT_ROWS, tile: int = TILE) -> Hot | None:
    """The same for tuples that stand at their vertices already, for ``expand_at``."""
    return hot_pairs(keyed.select("key"), edges.select(F.col("src").alias("key")), "key", limit, tile)


def _neighbours(edges: DataFrame) -> DataFrame:
    more = ["edge_label"] if _labelled(edges) else []
    return edges.select(F.col("src").alias("key"), F.col("dst").alias("w"), F.col("dst_label").alias("wl"), *more)


def expand(tuples: DataFrame, edges: DataFrame, max_vertices: int, keep: Column | None = None, rule: bool = True, hot: Hot | None = None) -> DataFrame:
    """All tuples with one edge more and at most ``max_vertices`` vertices.

    With ``rule`` a tuple is suppressed that the ordering rule says is found in another
    way; up to three edges each edge set then comes out exactly once, beyond some
    come out more often, and which depends on the vertex numbers. Without it every
    way to add an edge that is not there yet comes out. ``keep`` is a predicate on the new tuple's ``v, h, l, e``.
    ``hot``: vertices whose tuples and edges are cut into parts for the join (``hot_vertices``).

    Growth (a new vertex, one join on the vertex grown from) and closing (both ends in
    the tuple already, one join on both ends) are separate, so that tuples of full
    size are never joined with whole neighbourhoods.
    """
    # Under the rule a new edge must lie above all edges after the position it grows from.
    bar = F.array_max(F.slice("e", F.col("i") + 1, F.size("e")))
    seen = by_vertex(tuples)
    seen = seen.withColumn("_bar", bar) if rule else seen

    def allowed(x: DataFrame, w: Column) -> DataFrame:
        if not rule:
            return x
        return x.where((w > F.col("v")[0]) & (F.col("_bar").isNull() | (_edge(F.col("key"), w) > F.col("_bar"))))

    grown = seen.where(F.col("n") < max_vertices).transform(lambda x: salted_join(x, _neighbours(edges), "key", hot))
    grown = _appended(allowed(grown.where(~F.array_contains("v", F.col("w"))), F.col("w")), F.col("w"), F.col("wl"), F.col("n") + 1, F.col("n") + 1)
    # Closing edges: from the smaller end, between vertices of the tuple that are not joined yet.
    inside = seen.where(F.col("n") > 2).select("*", F.explode(F.array_distinct("v")).alias("w"))
    inside = inside.where((F.col("key") < F.col("w")) & ~F.array_contains("e", F.struct(F.col("key").alias("lo"), F.col("w").alias("hi"))))
    if rule:
        inside = inside.where((F.col("w") >= F.col("v")[0]) & (F.col("w") != F.get("v", F.get("h", F.col("i")))) & (F.col("_bar").isNull() | (_edge(F.col("key"), F.col("w")) > F.col("_bar"))))
    pairs = edges.where(F.col("src") < F.col("dst")).select(F.col("src").alias("key"), F.col("dst").alias("w"), *(["edge_label"] if _labelled(edges) else []))
    pairs = pairs.groupBy("key", "w").agg(F.min("edge_label").alias("edge_label")) if _labelled(edges) else pairs.distinct()
    at = _place(F.col("w"))
    closed = _appended(inside.join(pairs, ["key", "w"], "inner" if _labelled(edges) else "left_semi"), F.col("w"), F.get("l", at), F.get("q", at), F.col("n"))
    out = grown.unionByName(closed)
    return out if keep is None else out.where(keep)


def expand_at(keyed: DataFrame, edges: DataFrame, max_vertices: int, keep: Column | None = None, hot: Hot | None = None, growing: bool = False) -> DataFrame:
    """The shuffled form: tuples already replicated by ``by_vertex`` and spread by ``key`` grow at their key only.

    The same tuples as those of ``expand`` come out, left unspread; with ``growing`` without most of those from which
    the rule lets nothing grow, which then aren't built.
    """
    # What the rule asks of a tuple is read from it before the join, as plain columns.
    bar = F.array_max(F.slice("e", F.col("i") + 1, F.size("e")))
    keyed = keyed.withColumns({"_first": F.col("v")[0], "_from": F.get("v", F.get("h", F.col("i"))), "_bar": bar})
    keyed = keyed.withColumns({"_lo": F.col("_bar.lo"), "_hi": F.col("_bar.hi")}).drop("_bar")
    if growing:
        top = F.array_max("v")
        keyed = keyed.withColumns({"_top": top, "_second": F.array_max(F.array_remove("v", top)), "_other": F.array_max(F.array_remove("v", F.col("key")))})
    x = salted_join(keyed, _neighbours(edges), "key", hot)
    lo, hi = F.least("key", "w"), F.greatest("key", "w")
    x = x.where((F.col("w") >= F.col("_first")) & (F.col("w") != F.col("_from")) & (F.col("_lo").isNull() | (lo > F.col("_lo")) | ((lo == F.col("_lo")) & (hi > F.col("_hi")))))
    fresh = ~F.array_contains("v", F.col("w"))
    x = x.where(F.when(fresh, n_vertices() < max_vertices).otherwise(F.col("key") < F.col("w")))
    if growing:
        # A closing edge lies above the last edge, or leads from the last vertex to a larger one that it didn't grow from.
        top, second = F.greatest("_top", "w"), F.greatest("_second", F.least("_top", "w"))
        x = x.where(~fresh | (F.col("n") + 1 < max_vertices) | (second > lo) | ((second == lo) & (top > hi)) | (F.col("_other") > F.col("w")))
    more = F.when(fresh, F.col("n") + 1)
    out = _appended(x, F.col("w"), F.col("wl"), F.coalesce(more, F.get("q", _place(F.col("w")))), F.coalesce(more, F.col("n")))
    return out if keep is None else out.where(keep)


def expand_and_shuffle(keyed: DataFrame, edges: DataFrame, max_vertices: int, keep: Column | None = None, hot: Hot | None = None) -> DataFrame:
    """``expand_at`` and ``shuffle_by_vertex`` in one step: keyed tuples in, keyed tuples with one edge more out."""
    return shuffle_by_vertex(expand_at(keyed, edges, max_vertices, keep, hot))


def shuffle_by_vertex(tuples: DataFrame) -> DataFrame:
    """``by_vertex`` with rows spread by their key."""
    return by_vertex(tuples).repartition("key")


def by_vertex_growing(tuples: DataFrame, max_vertices: int) -> DataFrame:
    """The rows of ``by_vertex`` from which the rule may let a tuple grow: those of a full tuple only at a vertex with a closing edge that it allows."""
    bar = F.array_max(F.slice("e", F.col("i") + 1, F.size("e")))

    def closing(w: Column) -> Column:
        edge = F.struct(F.col("key").alias("lo"), w.alias("hi"))
        return (F.col("key") < w) & (w != F.get("v", F.get("h", F.col("i")))) & (bar.isNull() | (edge > bar)) & ~F.array_contains("e", edge)

    return by_vertex(tuples).where((F.col("n") < max_vertices) | F.exists("v", closing))


def by_degree(edges: DataFrame) -> DataFrame:
    """The same edges with vertices numbered in the order of their degrees.

    By the rule a cycle is closed from a tuple at its least vertices, which then are not hubs. Classes don't depend on the numbering.
    """
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    numbers = dense_numbers(edges.select(F.col("src").alias("id")).distinct()).join(degrees, "id")
    # At most 2^24 edges at a vertex and 2^38 vertices keep the order in 63 bits; larger degrees count as the largest.
    numbers = numbers.select("id", (F.least("degree", F.lit((1 << 24) - 1)) * (1 << 38) + F.col("number")).alias("_number"))
    for end in ("src", "dst"):
        edges = lookup(edges, numbers.withColumnsRenamed({"id": end, "_number": f"_{end}"}), end, hot_keys(edges, end, counts=degrees.select(F.col("id").alias(end), F.col("degree").alias("n"))))
        edges = edges.drop(end).withColumnRenamed(f"_{end}", end)
    return edges


def collect(tuples: DataFrame, keep: Column) -> DataFrame:
    """The tuples for which ``keep`` holds."""
    return tuples.where(keep)


def edge_sets(tuples: DataFrame) -> DataFrame:
    """One tuple for each distinct set of edges: the least by its columns.

    Rows are grouped by 128 bits of hash of the set, for sorting by arrays is slow.
    """
    columns = [c for c in (*COLUMNS, "g") if c in tuples.columns]
    sets = tuples.withColumn("_set", F.sort_array("e"))
    return sets.groupBy(F.xxhash64("_set"), F.xxhash64(F.lit("set"), F.col("_set"))).agg(F.min(F.struct(*columns)).alias("t")).select("t.*")


def quick_pattern(labelled: bool, edge_labels: bool = False) -> Column:
    """Text of a tuple with its vertices numbered in the order they appear: ``ids|history|labels|labels of edges``.

    Labels only if ``labelled``; ``edge_labels`` needs tuples with column ``g``.
    """
    parts = ["q", "h", *(["l"] if labelled or edge_labels else [])]
    texts = [F.concat_ws(",", F.col(c).cast("array<string>")) for c in parts]
    if edge_labels:
        own = F.col("l") if labelled else F.transform("l", lambda x: F.lit(0))
        texts = [*texts[:2], F.concat_ws(",", own.cast("array<string>")), F.concat_ws(",", F.transform("g", lambda x: F.coalesce(x, F.lit(0)).cast("string")))]
    return F.concat_ws("|", *texts)
