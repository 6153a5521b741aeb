"""Connected components by deterministic Borůvka hooking.

Edges are ordered by their ends (smaller end first). Each component selects its smallest
outgoing edge; this gives trees whose only cycle is the tree's least edge, selected from both its
ends. The smaller end of that edge is the tree's root. Trees collapse by pointer doubling,
edges are relabelled to roots and deduplicated, and the next round starts, until no edge is
left. The number of components at least halves each round, so there are at most log2 n
rounds whatever the diameter. By this order the root of a tree is its least vertex, so
the last root is the least vertex of the group.

The first round always runs distributed. What is left of a forest or of a contracted graph goes through
the same steps in the memory of one task once it has no more than ``small`` rows
(of 16 bytes), for a round of jobs costs more than that task's second or two. The size is
checked before; a larger graph stays distributed round after round.

The maps of the rounds (component to root) shrink at least by half each; they are
composed from the last back to the first. All tables are cut into the shared folder, hot
components are met by broadcast (see runtime.lookup).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import HOT_ROWS, Workspace, hot_keys, lookup

#: Rows of a forest or contracted graph that one task takes.
SMALL = 1_000_000


def _doubled(root):
    """Every pointer moved to the root of its tree."""
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _rooted(parent):
    """The smaller end of each tree's least edge, which was selected from both ends, points to itself."""
    import numpy as np

    own = np.arange(len(parent))
    return np.where((parent[parent] == own) & (own < parent), own, parent)


def _hook(a, b, n: int):
    """The root of each vertex 0 .. n-1 after one round over edges (a, b)."""
    import numpy as np

    own, parent = np.arange(n), np.full(n, n)
    np.minimum.at(parent, a, b)
    np.minimum.at(parent, b, a)
    return _doubled(_rooted(np.where(parent == n, own, parent)))


def _two_columns(batches: Iterator):
    """The two columns of all batches as ranks of their values, and the values."""
    import numpy as np
    import pyarrow as pa

    held = list(batches)
    if not held:
        return None
    table = pa.Table.from_batches(held)
    values = pa.concat_arrays([c for i in (0, 1) for c in table.column(i).chunks]).to_numpy(zero_copy_only=False)
    ids, ranks = np.unique(values, return_inverse=True)
    return ranks[: table.num_rows], ranks[table.num_rows :], ids, table.schema


def _as_batch(ids, root, schema):
    import pyarrow as pa

    kind = schema.field(0).type
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[root], kind)], names=["c", "p"])


def _all_rounds(batches: Iterator) -> Iterator:
    """(c, p) of all vertices of edges (lo, hi), every round in memory."""
    import numpy as np

    if (got := _two_columns(batches)) is None:
        return
    a, b, ids, schema = got
    root = np.arange(len(ids))
    while len(a):
        step = _hook(a, b, len(ids))
        root = step[root]
        a, b = step[a], step[b]
        left = a != b
        pairs = np.unique(np.minimum(a[left], b[left]) * len(ids) + np.maximum(a[left], b[left]))
        a, b = pairs // len(ids), pairs % len(ids)
    yield _as_batch(ids, root, schema)


def _collapsed(batches: Iterator) -> Iterator:
    """(c, root) of hooked vertices (c, p)."""
    import numpy as np

    if (got := _two_columns(batches)) is None:
        return
    c, p, ids, schema = got
    root = np.arange(len(ids))
    root[c] = p
    yield _as_batch(ids, _doubled(_rooted(root)), schema)


def _in_one_task(df: DataFrame, steps, kind: str) -> DataFrame:
    return df.coalesce(1).mapInArrow(steps, f"c {kind}, p {kind}")


def _roots(work: Workspace, hooked: DataFrame, n: int, kind: str, limit: int, small: int) -> DataFrame:
    """(c, root) of the trees of ``hooked`` (c, p)."""
    if n <= small:
        return work.cut(_in_one_task(hooked, _collapsed, kind))
    # Both ends of a tree's least edge hook to each other: the smaller one is the root. All others go up two steps at once.
    above = hooked.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    rooted = lookup(hooked, above, "p", hot_keys(hooked, "p", n, limit=limit))
    table = work.cut(rooted.select("c", F.when(F.col("pp") == F.col("c"), F.least("c", "p")).otherwise(F.col("pp")).alias("p")))
    done: list[DataFrame] = []
    open_ = table
    # A pointer that didn't move points to a root: its vertex is settled and isn't joined again. All pointers still in use are in ``table``.
    while (left := open_.count()) > 0:
        above = table.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        step = work.cut(lookup(open_, above, "p", hot_keys(open_, "p", left, limit=limit)).select("c", F.col("pp").alias("p"), (F.col("p") == F.col("pp")).alias("settled")))
        done.append(step.where("settled").select("c", "p"))
        open_ = step.where(~F.col("settled")).select("c", "p")
        out = open_
        for d in done:
            out = out.unionByName(d)
        table = out
    return table


def component_map(ends: DataFrame, limit: int = HOT_ROWS, small: int = SMALL) -> DataFrame:
    """``c, p``: for every vertex of ``ends`` (lo, hi; lo < hi, rows may repeat) the least vertex of its component.

    ``limit``: rows of a key above which it is hot; ``small``: see above, 0 keeps every round distributed.
    """
    work = Workspace(ends.sparkSession, "components")
    kind = ends.schema["lo"].dataType.simpleString()
    edges, maps, first = work.cut(ends.select("lo", "hi")), [], True
    while (n_edges := edges.count()) > 0:
        if not first and n_edges <= small:
            maps.append(work.cut(_in_one_task(edges, _all_rounds, kind)))
            break
        # The smallest edge (smaller end first) of a component is the one to its least neighbour, whichever end that is.
        outgoing = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("c"), F.col("hi").alias("p")), F.struct(F.col("hi").alias("c"), F.col("lo").alias("p")))).alias("x"))
        hooked = work.cut(outgoing.groupBy("x.c").agg(F.min("x.p").alias("p"), F.count("*").alias("n")))
        n = hooked.count()
        roots = _roots(work, hooked.select("c", "p"), n, kind, limit, small)
        maps.append(roots)
        hot = hot_keys(None, "c", 2 * n_edges, hooked.select("c", "n"), limit)
        half = lookup(edges.withColumnRenamed("lo", "c"), roots, "c", hot).select(F.col("p").alias("r1"), F.col("hi").alias("c"))
        whole = lookup(half, roots, "c", hot).select("r1", F.col("p").alias("r2")).where(F.col("r1") != F.col("r2"))
        nxt = work.cut(whole.select(F.least("r1", "r2").alias("lo"), F.greatest("r1", "r2").alias("hi")).distinct())
        work.drop(edges, hooked)
        edges, first = nxt, False
    if not maps:
        return edges.select(F.col("lo").alias("c"), F.col("lo").alias("p"))
    final = maps.pop()
    while maps:
        inner = maps.pop()
        # A root that hooked nowhere later keeps itself.
        outer = final.select(F.col("c").alias("p"), F.col("p").alias("g"))
        joined = lookup(inner, outer, "p", hot_keys(inner, "p", inner.count(), limit=limit), "left")
        final = joined.select("c", F.coalesce("g", "p").alias("p"))
        final = work.cut(final) if maps else final
    return final
