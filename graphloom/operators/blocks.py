"""Triangles in tasks that hold a bounded part of the edges, so that no two-edge path is shuffled.

Vertices are cut into ranges of ids, and edges ``lo < hi`` into blocks by the ranges of their ends. A triangle
x < y < z has its edges in the blocks (i, j), (i, k) and (j, k) of its ranges i <= j <= k, so the task of
(i, j, k) meets it and no other does. Blocks are sent only to tasks none of whose blocks is empty; of P ranges an
edge goes to P tasks at most, to fewer where linked ids are near each other. A task tries for each
edge of one block the shorter of the two lists that may close it, so hubs aren't met with all their neighbours twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import MOST_TASKS

#: A task has about so many edges at most; it has fewer of a small table, which is cut into so many shares. Below LEAST_EDGES nothing is cut.
MOST_EDGES, SHARES, LEAST_EDGES = 6_000_000, 16, 250_000
#: Bounds from each end of the edges, for up to twice as many ranges.
BOUNDS = 128
#: Edges packed together; paths tried together.
PACK, CHUNK = 1 << 20, 1 << 20

_SENT = "t long, i int, j int, lo long, hi long, span long, width int, data binary"


def triangles(pairs: DataFrame, most: int = MOST_EDGES, least: int = LEAST_EDGES) -> DataFrame:
    """``a, b, c`` ascending: each triangle of a written table of distinct ``lo, hi`` (whole numbers, lo < hi) once."""
    pairs = pairs.select(F.col("lo").cast("long"), F.col("hi").cast("long"))
    part = [(n + 1) / BOUNDS for n in range(BOUNDS - 1)]
    bounds = pairs.agg(*[F.percentile_approx(x, part, 2000) for x in ("lo", "hi")]).first()
    cuts = np.unique(np.array([*(bounds[0] or []), *(bounds[1] or [])], dtype="int64"))
    n = len(cuts) + 1
    sizes = np.zeros((n, n), dtype="int64")
    for r in pairs.mapInArrow(_counted(cuts), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        sizes[divmod(r["block"], n)] = r["n"]
    group, tasks = _plan(sizes, min(most, max(least, int(sizes.sum()) // SHARES)))
    sent = pairs.mapInArrow(_sent(cuts, group, tasks), _SENT)
    parts = max(1, min(len(tasks), MOST_TASKS))
    # Blocks of a partition's tasks come one task after the other.
    return sent.repartitionById(parts, (F.col("t") % parts).cast("int")).sortWithinPartitions("t").mapInArrow(_met(tasks), "a long, b long, c long")


def _plan(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """From the edges of each block of fine ranges: the coarse range of each, and the tasks i, j, k with at most ``most`` edges, as far as fine ranges allow."""
    n, weight = len(sizes), sizes.sum(axis=0) + sizes.sum(axis=1)
    before, total = np.cumsum(weight) - weight, max(1, int(weight.sum()))
    p = 1
    while True:
        group = np.minimum((before * p) // total, p - 1) if p < n else np.arange(n)
        blocks = np.zeros((p, p), dtype="int64")
        np.add.at(blocks, (group[:, None], group[None, :]), sizes)
        tasks, edges = _tasks(blocks)
        if p >= n or not len(edges) or edges.max() <= most:
            # The largest first, one to a partition as far as there are partitions.
            return group, tasks[np.argsort(-edges, kind="stable")]
        p = min(n, max(p + 1, p * 9 // 8))


def _tasks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i <= j <= k with no empty block among (i, j), (i, k), (j, k), and their edges."""
    out, sums = [np.zeros((0, 3), dtype="int64")], [np.zeros(0, dtype="int64")]
    for i in range(len(blocks)):
        for j in np.flatnonzero(blocks[i, i:]) + i:
            k = np.flatnonzero((blocks[i, j:] > 0) & (blocks[j, j:] > 0)) + j
            out.append(np.stack([np.full(len(k), i), np.full(len(k), j), k], axis=1))
            # Equal blocks are sent once: (i, k) is (j, k) if i = j, and (i, j) is (i, k) if j = k.
            sums.append(blocks[i, j] * (k != j) + blocks[i, k] + blocks[j, k] * (i != j))
    return np.concatenate(out), np.concatenate(sums)


def _counted(cuts: np.ndarray):
    """Edges to the number of edges in each block of fine ranges."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cuts) + 1
        got = np.zeros(n * n, dtype="int64")
        for x in rows:
            at = np.searchsorted(cuts, x.column(0).to_numpy(), side="right") * n + np.searchsorted(cuts, x.column(1).to_numpy(), side="right")
            block, many = np.unique(at, return_counts=True)
            got[block] += many
        block = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(got[block])], names=["block", "n"])

    return run


def _packed(lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, int, bytes]:
    """Distinct edges as the differences of one ascending number for each; as they are (span 0) where 64 bits are too few."""
    low, first = int(lo.min()), int(hi.min())
    span = int(hi.max()) - first + 1
    if (int(lo.max()) - low + 1) * span >= 1 << 63:
        return low, first, 0, 8, lo.tobytes() + hi.tobytes()
    steps = np.diff(np.sort((lo - low) * span + (hi - first)), prepend=0)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(steps.max()) < 1 << 8 * w)
    return low, first, span, width, steps.astype(f"u{width}").tobytes()


def _unpacked(low: int, first: int, span: int, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not span:
        both = np.frombuffer(data, dtype="int64")
        return both[: len(both) // 2], both[len(both) // 2 :]
    lo, hi = np.divmod(np.cumsum(np.frombuffer(data, dtype=f"u{width}"), dtype="int64"), span)
    return lo + low, hi + first


def _sent(cuts: np.ndarray, group: np.ndarray, tasks: np.ndarray):
    """Edges to packed parts of blocks, one for each task that needs the block."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = int(group.max()) + 1
        to: dict[int, list[int]] = {}
        for t, (i, j, k) in enumerate(tasks.tolist()):
            for block in {i * p + j, i * p + k, j * p + k}:
                to.setdefault(block, []).append(t)

        def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            lo, hi = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            at = group[np.searchsorted(cuts, lo, side="right")] * p + group[np.searchsorted(cuts, hi, side="right")]
            order = np.argsort(at, kind="stable")
            lo, hi, at = lo[order], hi[order], at[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for start, stop in zip(starts, [*starts[1:], len(at)], strict=True):
                block = int(at[start])
                if block in to:
                    low, first, span, width, data = _packed(lo[start:stop], hi[start:stop])
                    for t in to[block]:
                        yield pa.RecordBatch.from_pylist([{"t": t, "i": block // p, "j": block % p, "lo": low, "hi": first, "span": span, "width": width, "data": data}], schema=_schema())

        held, n = [], 0
        for x in rows:
            if x.num_rows:
                held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
                n += x.num_rows
            if n >= PACK:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    return run


def _schema() -> pa.Schema:
    return pa.schema([("t", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("span", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])


def _met(tasks: np.ndarray):
    """Packed blocks, task by task, to triangles."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = -1, {}

        def out() -> Iterator[pa.RecordBatch]:
            i, j, k = tasks[now].tolist()
            edges = {b: tuple(np.concatenate([e[c] for e in es]) for c in (0, 1)) for b, es in blocks.items()}
            blocks.clear()
            for found in met(edges[i, j], edges[i, k], edges[j, k]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "c"])

        for batch in rows:
            for r in batch.to_pylist():
                if r["t"] != now:
                    if blocks:
                        yield from out()
                    now = r["t"]
                blocks.setdefault((r["i"], r["j"]), []).append(_unpacked(r["lo"], r["hi"], r["span"], r["width"], r["data"]))
        if blocks:
            yield from out()

    return run


def _numbered(*ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids of one range, and the ends as numbers of them."""
    low, n = min(int(e.min()) for e in ends), sum(len(e) for e in ends)
    span = max(int(e.max()) for e in ends) - low + 1
    if span <= 4 * n:
        return low + np.arange(span), [(e - low).astype("int32") for e in ends]
    ids = np.unique(np.concatenate(ends))
    return ids, [np.searchsorted(ids, e).astype("int32") for e in ends]


class _Lists:
    """The neighbours of each vertex of one range in another, and whether a pair is linked."""

    def __init__(self, of: np.ndarray, to: np.ndarray, n: int, m: int) -> None:
        self.codes, self.m = np.sort(of.astype("int64") * m + to), m
        self.degree = np.bincount(of, minlength=n)
        self.starts = np.cumsum(self.degree) - self.degree
        bits = max(10, (8 * len(of)).bit_length())
        self.shift = np.uint64(64 - bits)
        # Marks of hashed pairs: most pairs that aren't linked are told by them.
        self.marks = np.zeros(1 << bits, dtype=bool)
        self.marks[self._mark(self.codes)] = True

    def _mark(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def linked(self, of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Positions of linked pairs."""
        codes = of.astype("int64") * self.m + to
        maybe = np.flatnonzero(self.marks[self._mark(codes)])
        codes = codes[maybe]
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return maybe[self.codes[at] == codes]


def met(xy: tuple[np.ndarray, np.ndarray], xz: tuple[np.ndarray, np.ndarray], yz: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays of x, y, z with an edge of each kind between them, each once."""
    xs, (x1, x2) = _numbered(xy[0], xz[0])
    ys, (y1, y3) = _numbered(xy[1], yz[0])
    zs, (z2, z3) = _numbered(xz[1], yz[1])
    nx, ny, nz = len(xs), len(ys), len(zs)
    degree = {(of, to): np.bincount(e, minlength=n) for of, to, e, n in (("x", "y", x1, nx), ("x", "z", x2, nx), ("y", "x", y1, ny), ("y", "z", y3, ny), ("z", "x", z2, nz), ("z", "y", z3, nz))}
    kinds = (("x", "y", "z", x1, y1), ("x", "z", "y", x2, z2), ("y", "z", "x", y3, z3))
    # The kind of edge from which the fewest paths go on.
    p, q, r, ps, qs = min(kinds, key=lambda k: int(np.minimum(degree[k[0], k[2]][k[3]], degree[k[1], k[2]][k[4]]).sum()))
    ends = {("x", "y"): (x1, y1), ("x", "z"): (x2, z2), ("y", "z"): (y3, z3)}
    size, ids = {"x": nx, "y": ny, "z": nz}, {"x": xs, "y": ys, "z": zs}
    from_p, from_q = (_Lists(*(ends[v, r] if (v, r) in ends else ends[r, v][::-1]), size[v], size[r]) for v in (p, q))
    shorter = from_p.degree[ps] <= from_q.degree[qs]
    for own, other, mine, theirs in ((from_p, from_q, ps[shorter], qs[shorter]), (from_q, from_p, qs[~shorter], ps[~shorter])):
        many = own.degree[mine]
        ends_at = np.cumsum(many)
        start = 0
        while start < len(mine):
            done = int(ends_at[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends_at, done + CHUNK, side="right")))
            each = many[start:stop]
            # Where each path's last vertex stands in the list of its edge.
            at = np.repeat(own.starts[mine[start:stop]] - (ends_at[start:stop] - each - done), each) + np.arange(int(ends_at[stop - 1]) - done)
            of = np.repeat(np.arange(start, stop), each)
            last = own.codes[at] - mine[of].astype("int64") * own.m
            hit = other.linked(theirs[of], last)
            if len(hit):
                of, found = of[hit], {r: ids[r][last[hit]]}
                found |= {p: ids[p][(mine if own is from_p else theirs)[of]], q: ids[q][(theirs if own is from_p else mine)[of]]}
                yield found["x"], found["y"], found["z"]
            start = stop
