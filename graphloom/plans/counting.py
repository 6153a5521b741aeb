"""Numbers of small subgraphs by class, without building the subgraphs.

Where only counts are wanted, stars and paths follow from degrees, triangles from
edges that point to the end of larger degree, four-cycles from their paths below the highest
vertex, and labelled wedges from the labels around each centre. The results are
those of growing all subgraphs and counting them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, undirected
from graphloom.operators import blocks, label_pairs
from graphloom.operators.patterns import with_patterns
from graphloom.operators.triangles import oriented, triangles_of
from graphloom.runtime import HOT_ROWS, TILE, Hot, Workspace, hot_by_bucket, hot_keys, hot_pairs, lookup, salted_join, setting

#: A task that meets triangles for ``rule_counts`` has about so many edges at least, so that an edge goes to few tasks.
LEAST_EDGES = 3_000_000


def labelled_table(graph: Graph, work: Workspace, limit: int = HOT_ROWS) -> DataFrame:
    """The distinct labelled edges of a symmetric graph, written once."""
    if "edge_label" in graph.edges.columns:
        edges = graph.edges.groupBy("src", "dst").agg(F.min("edge_label").alias("edge_label"))
    else:
        edges = graph.edges.select("src", "dst").distinct()
    edges = work.cut(edges)
    return work.cut(Graph(edges, graph.vertices).labelled_edges(hot_keys(edges, "src", edges.count(), limit=limit)))


def _sum(x: Column) -> Column:
    """An exact sum whose parts may go beyond 64 bits."""
    return F.sum(x.cast("decimal(38,0)")).cast("long")


def _choose(d: str, k: int) -> Column:
    """How many ways there are to choose k (2 or 3) of d."""
    n = F.col(d).cast("decimal(12,0)")
    return n * (n - 1) / 2 if k == 2 else n * (n - 1) * (n - 2) / 6


def _squares(out: DataFrame) -> DataFrame:
    """``k``: cycles of four edges, each counted at its highest vertex u by (degree, id): two ways u - v - w below u.

    v is the lower end of its edge to u, so that few ways are built even at hubs.
    """
    up = out.select(F.col("a").alias("v"), F.col("b").alias("u"), F.col("db").alias("du"))
    near = out.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w"), F.col("db").alias("dw")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"), F.col("da").alias("dw")))).alias("x")).select("x.*")
    hot = hot_pairs(up.select("v"), near.select("v"), "v") if out.count() > TILE else None
    ways = salted_join(up, near, "v", hot, "u", "w")
    ways = ways.where((F.col("dw") < F.col("du")) | ((F.col("dw") == F.col("du")) & (F.col("w") < F.col("u"))))
    return ways.groupBy("u", "w").agg(F.count("*").alias("n")).agg(_sum(_choose("n", 2)).alias("k"))


def motif_counts(edges: DataFrame, max_vertices: int, top: int) -> DataFrame:
    """``pattern, n_vertices, n_edges, support`` of all connected subgraphs of 2 .. ``top`` (at most 4) edges on at most ``max_vertices`` (3 or 4) vertices."""
    work = Workspace(edges.sparkSession, "counting")
    pairs = work.cut(undirected(edges))
    out = work.cut(oriented(pairs))
    degrees = out.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("da").alias("d")), F.struct(F.col("b").alias("x"), F.col("db").alias("d")))).alias("s")).select("s.*").groupBy("x").agg(F.first("d").alias("d"))
    four = max_vertices == 4
    stars = degrees.agg(_sum(_choose("d", 2)).alias("wedge"), _sum(_choose("d", 3)).alias("star"))
    one = [stars]
    if top >= 3:
        at = triangles_of(out if four else out.select("a", "b"), pairs)
        one.append(at.agg(F.count("*").alias("triangle"), *([_sum(F.col("da") + F.col("db") + F.col("dc") - 6).alias("tail")] if four else [])))
    if top >= 3 and four:
        one.append(out.agg(_sum((F.col("da") - 1).cast("decimal(12,0)") * (F.col("db") - 1)).alias("paths")))
    if top >= 4 and four:
        one.append(_squares(out).select(F.col("k").alias("square")))
    # Each of these is one row.
    row = reduce(lambda x, y: x.join(y, "_one"), [o.withColumn("_one", F.lit(1)) for o in one])
    classes = [("0 0 0|0-1 0-2", 3, 2, F.col("wedge"))]
    if top >= 3:
        classes.append(("0 0 0|0-1 0-2 1-2", 3, 3, F.col("triangle")))
    if top >= 3 and four:
        classes += [("0 0 0 0|0-1 0-2 0-3", 4, 3, F.col("star")), ("0 0 0 0|0-1 0-2 1-3", 4, 3, F.col("paths") - 3 * F.col("triangle"))]
    if top >= 4 and four:
        classes += [("0 0 0 0|0-1 0-2 1-3 2-3", 4, 4, F.col("square")), ("0 0 0 0|0-1 0-2 0-3 1-2", 4, 4, F.col("tail"))]
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("n_vertices"), F.lit(e).alias("n_edges"), k.cast("long").alias("support")) for p, v, e, k in classes])
    return row.select(F.explode(rows).alias("r")).select("r.*").where(F.col("support") > 0)


def frequent_counts(graph: Graph, levels: int, support: int, max_vertices: int) -> dict[int, DataFrame]:
    """For each number of edges the frequent labelled classes with at most three vertices (``pattern, n_vertices, n_edges, support``).

    A class is a candidate if one of its parts with one edge less is frequent, which its labels tell.
    """
    work = Workspace(graph.edges.sparkSession, "frequent")
    edges = labelled_table(graph, work)
    often = F.col("support") >= support
    low, high = F.least("src_label", "dst_label"), F.greatest("src_label", "dst_label")
    links = work.cut(edges.where(F.col("src") < F.col("dst")).groupBy(low.alias("l0"), high.alias("l1")).agg(F.count("*").alias("support")).where(often))
    quick = F.concat(F.lit("1,2|0,0|"), F.concat_ws(",", "l0", "l1"))
    out = {1: with_patterns(links.select(quick.alias("quick"), "support"))}
    none = out[1].where(F.lit(False))
    if levels >= 2 and max_vertices >= 3:
        # How many neighbours of each label a vertex has, and whether such an edge is frequent.
        near = edges.groupBy("src", "src_label", "dst_label").agg(F.count("*").alias("n"))
        marked = near.join(links.select(F.col("l0").alias("_l0"), F.col("l1").alias("_l1"), F.lit(True).alias("ok")), (low == F.col("_l0")) & (high == F.col("_l1")), "left")
        near = work.cut(marked.select("src", "src_label", F.col("dst_label").alias("x"), "n", F.coalesce("ok", F.lit(False)).alias("ok")))
        other = near.select("src", F.col("x").alias("y"), F.col("n").alias("m"), F.col("ok").alias("ok_y"))
        hot = hot_pairs(near, near, "src") if near.count() > TILE else None
        both = salted_join(near, other, "src", hot, "x", "y").where((F.col("x") <= F.col("y")) & (F.col("ok") | F.col("ok_y")))
        ways = F.when(F.col("x") < F.col("y"), F.col("n") * F.col("m")).otherwise(F.expr("n * (n - 1) div 2"))
        wedges = work.cut(both.groupBy(F.col("src_label").alias("c"), "x", "y").agg(F.sum(ways).alias("support")).where(often))
        quick = F.concat(F.lit("1,2,3|0,0,0|"), F.concat_ws(",", "c", "x", "y"))
        out[2] = with_patterns(wedges.select(quick.alias("quick"), "support"))
    if levels >= 3 and max_vertices >= 3:
        pairs = work.cut(edges.where(F.col("src") < F.col("dst")).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.col("src_label").alias("l_lo"), F.col("dst_label").alias("l_hi")))
        found = triangles_of(work.cut(oriented(pairs).select("a", "b", "l_a", "l_b")), pairs)
        l = F.sort_array(F.array("l_a", "l_b", "l_c"))  # noqa: E741
        counts = work.cut(found.groupBy(l[0].alias("x"), l[1].alias("y"), l[2].alias("z")).agg(F.count("*").alias("support")).where(often))
        corners = [F.struct(F.col(c).alias("c"), F.col(x).alias("x"), F.col(y).alias("y")) for c, x, y in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))]
        known = counts.select(F.struct("x", "y", "z").alias("t"), "support", F.explode(F.array(*corners)).alias("w")).select("t", "support", "w.*")
        kept = known.join(wedges.select("c", "x", "y"), ["c", "x", "y"], "left_semi").select("t.*", "support").distinct()
        quick = F.concat(F.lit("1,2,3,1|0,0,1,2|"), F.concat_ws(",", "x", "y", "z", "x"))
        out[3] = with_patterns(kept.select(quick.alias("quick"), "support"))
    return {n: out.get(n, none) for n in range(1, levels + 1)}


def _with_labels(df: DataFrame, labels: DataFrame, ends: dict[str, str], hot: Hot | None) -> DataFrame:
    """``df`` with the labels of its columns ``ends`` under the names given; ``labels`` (id, label) needs no rows of label 0."""
    for end, name in ends.items():
        df = lookup(df, labels.select(F.col("id").alias(end), F.col("label").alias(name)), end, hot, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def labelled_pairs(graph: Graph, work: Workspace, limit: int = HOT_ROWS) -> DataFrame:
    """``lo, hi, l_lo, l_hi``: each pair of linked vertices once, whether it is linked in one direction or both, with the labels of its ends."""
    raw = graph.edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    hot = hot_by_bucket(raw.select(F.explode(F.array("lo", "hi")).alias("x")), "x", limit)
    # Without hot keys, pairs are made distinct where they meet their first label.
    pairs = raw.repartition("lo").distinct() if hot is None else work.cut(raw.distinct())
    labels = graph.vertices.where(F.col("label") != 0)
    for end in ("lo", "hi"):
        # The first join leaves pairs in the order of lo, which packs well; for the second, labels are hashed where each part of them is small.
        with setting(work.spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "0" if end == "lo" else "32m"):
            more = work.cut(_with_labels(pairs, labels, {end: f"l_{end}"}, hot), compression="zstd")
        work.drop(pairs)
        pairs = more
    return pairs


def rule_counts(graph: Graph, levels: int, support: int, filter_last: bool, limit: int = HOT_ROWS, most_labels: int = TILE, rows: int = label_pairs.ROWS) -> dict[int, DataFrame]:
    """For each number of edges the labelled classes of ``plans.building.frequent_subgraphs`` in ``parity``: ids are whole numbers, labels of 32 bits.

    A wedge grows from its edge to the smaller end, if that edge is of a frequent class. That both edges are, or neither, is told by
    labels, so these wedges are counted by the labels around each centre; wedges with one such edge are built, as their order counts.
    """
    work = Workspace(graph.edges.sparkSession, "rule")
    pairs = labelled_pairs(graph, work, limit)
    often = F.col("support") >= support

    def kept(n: int, counts: DataFrame) -> DataFrame:
        return counts if n == levels and not filter_last else counts.where(often)

    def described(counts: DataFrame, pattern: Column, n_vertices: int, n_edges: int) -> DataFrame:
        return counts.select(pattern.alias("pattern"), F.lit(n_vertices).alias("n_vertices"), F.lit(n_edges).alias("n_edges"), "support")

    of = {"l0": F.least("l_lo", "l_hi"), "l1": F.greatest("l_lo", "l_hi")}
    classes = work.cut(pairs.groupBy(*[c.alias(x) for x, c in of.items()]).agg(F.count("*").alias("support"), F.min("lo").cast("long").alias("low"), F.max("hi").cast("long").alias("high")))
    links = classes.where(often)
    out = {1: described(kept(1, classes), F.concat(F.concat_ws(" ", "l0", "l1"), F.lit("|0-1")), 2, 1)}
    none = out[1].where(F.lit(False))
    if levels >= 2:
        ends = F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(f"l_{v}").alias("c"), F.col(o).alias("o"), F.col(f"l_{o}").alias("x")) for v, o in (("lo", "hi"), ("hi", "lo"))]))
        rare = not classes.where(~often).isEmpty()

        def frequent(how: str) -> DataFrame:
            return pairs.withColumns(of).join(F.broadcast(links.select("l0", "l1")), ["l0", "l1"], how) if rare else pairs

        def near(how: str) -> DataFrame:
            return frequent(how).select(ends.alias("e")).select("e.*")

        by_label = links.select(F.explode(F.array(F.struct(F.col("l0").alias("c"), F.col("support").alias("n")), F.struct(F.col("l1").alias("c"), F.col("support").alias("n")))).alias("e")).groupBy("e.c").agg(F.sum("e.n").alias("n"))
        few = by_label.limit(most_labels + 1).collect()
        if len(few) <= most_labels:
            low, high = links.agg(F.min("low"), F.max("high")).first()
            found = label_pairs.edge_pair_counts(frequent("left_semi"), {r["c"]: r["n"] for r in few}, low or 0, high or 0, rows)
        else:
            one = work.cut(near("left_semi").groupBy("v", "c", "x").agg(F.count("*").alias("n")))
            two = one.select("v", F.col("x").alias("y"), F.col("n").alias("m"))
            ways = F.when(F.col("x") < F.col("y"), F.col("n") * F.col("m")).otherwise(F.expr("n * (n - 1) div 2"))
            found = salted_join(one, two, "v", hot_pairs(one, one, "v"), "x", "y").where("x <= y").groupBy("c", "x", "y").agg(F.sum(ways).alias("support")).where("support > 0")
        if rare:
            a, b = near("left_semi").select("v", "c", F.col("o").alias("a"), F.col("x").alias("la")), near("left_anti").select("v", F.col("o").alias("b"), F.col("x").alias("lb"))
            mixed = salted_join(a, b, "v", hot_pairs(a.select("v"), b.select("v"), "v"), "a", "b").where(F.col("a") < F.col("b"))
            mixed = mixed.groupBy("c", F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.count("*").alias("support"))
            found = found.unionByName(mixed).groupBy("c", "x", "y").agg(F.sum("support").alias("support"))
        wedges = work.cut(kept(2, found))
        c, x, y = F.col("c"), F.col("x"), F.col("y")
        codes = ((c <= x, (c, x, y), "|0-1 0-2"), (c <= y, (x, c, y), "|0-1 1-2"), (F.lit(True), (x, y, c), "|0-2 1-2"))
        out[2] = described(wedges, F.coalesce(*[F.when(when, F.concat(F.concat_ws(" ", *labels), F.lit(shape))) for when, labels, shape in codes]), 3, 2)
    if levels >= 3:
        found = work.cut(blocks.triangles(pairs, least=LEAST_EDGES))
        work.drop(pairs)
        corners = found.select(F.explode(F.array("a", "b", "c")).alias("id"))
        labels = work.cut(graph.vertices.where(F.col("label") != 0).join(corners.distinct(), "id", "left_semi").select("id", "label"))
        hot = hot_by_bucket(corners.withColumnRenamed("id", "x"), "x", limit)
        sorts = _with_labels(found, labels, {"a": "la", "b": "lb", "c": "lc"}, hot).groupBy("la", "lb", "lc").agg(F.count("*").alias("support"))
        # The tuple of a triangle grows from the wedge at its least vertex.
        grown = sorts.withColumns({"l0": F.least("la", "lb"), "l1": F.greatest("la", "lb")}).join(F.broadcast(links.select("l0", "l1")), ["l0", "l1"], "left_semi")
        grown = grown.withColumns({"x": F.least("lb", "lc"), "y": F.greatest("lb", "lc")}).join(wedges.select(F.col("c").alias("la"), "x", "y"), ["la", "x", "y"], "left_semi")
        counts = grown.groupBy(F.sort_array(F.array("la", "lb", "lc")).alias("t")).agg(F.sum("support").alias("support"))
        out[3] = described(work.cut(kept(3, counts)), F.concat(F.array_join("t", " "), F.lit("|0-1 0-2 1-2")), 3, 3)
        work.drop(found, labels)
    return {n: out.get(n, none) for n in range(1, levels + 1)}
