"""How many pairs of neighbours of each two labels there are around the vertices of each label.

Rows ``v, c, x`` (a vertex, its label, the label of a neighbour) are sent by the vertex's label, so all
pairs around one label are summed in one task and only classes leave it. A label with many rows is cut by
vertex into parts. What is worked on is the labels around each vertex, not its pairs of neighbours: a hub
with d neighbours of k labels takes k * k / 2 steps, not d * d / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Hot, hot_keys

#: Rows that a task holds, about; pairs of labels worked on together; classes of one label that are summed in an array.
ROWS, CHUNK, DENSE = 2_000_000, 1 << 20, 1 << 22


def pair_counts(near: DataFrame, rows: int, hot: Hot | None) -> DataFrame:
    """``c, x, y, support`` with x <= y from ``near`` (v, c, x), which has so many ``rows``. ``hot``: labels ``c`` with more than ROWS of them."""
    parts = _parts(near, rows)
    if hot is None:
        return near.repartition(parts, "c").mapInArrow(_summed, _SUMS)
    marked = hot.on(["c"]).mark(near).withColumn("_s", F.pmod(F.xxhash64("v"), F.col("_pl"))).select("v", "c", "x", "_s")
    sums = marked.repartition(parts, "c", "_s").select("v", "c", "x").mapInArrow(_summed, _SUMS)
    return sums.groupBy("c", "x", "y").agg(F.sum("support").alias("support"))


def edge_pair_counts(pairs: DataFrame, by_label: dict[int, int], low: int, high: int, most: int = ROWS) -> DataFrame:
    """``pair_counts`` of edges ``lo, hi, l_lo, l_hi`` in both directions, which are packed on their way.

    ``by_label``: the rows of each label, in all those of both directions; ids go from ``low`` to ``high``.
    """
    labels = np.array(sorted(by_label), dtype="int64")
    split = np.array([-(-by_label[c] // most) for c in labels.tolist()], dtype="int64")
    units, k, span, rows = int(split.sum()), max(1, len(labels)), high - low + 1, sum(by_label.values())
    if units * span * k >= 1 << 63:
        ends = [F.struct(F.col(v).alias("v"), F.col(f"l_{v}").alias("c"), F.col(f"l_{o}").alias("x")) for v, o in (("lo", "hi"), ("hi", "lo"))]
        near = pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*")
        counts = near.sparkSession.createDataFrame([(int(c), int(n)) for c, n in by_label.items()], "c int, n long")
        return pair_counts(near, rows, hot_keys(None, "c", counts=counts, limit=most))
    parts = min(_parts(pairs, rows), max(1, units))
    sent = pairs.select("lo", "hi", "l_lo", "l_hi").mapInArrow(_sent(labels, split, low, span, parts), "t int, first long, width int, data binary")
    sums = sent.repartitionById(parts, F.col("t")).mapInArrow(_met(labels, split, span), _SUMS)
    return sums if (split <= 1).all() else sums.groupBy("c", "x", "y").agg(F.sum("support").alias("support"))


_SUMS = "c int, x int, y int, support long"


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _sent(labels: np.ndarray, split: np.ndarray, low: int, span: int, parts: int):
    """Edges to packed numbers of (part of a label, vertex, neighbour's label), for each task together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, units, base = len(labels), int(split.sum()), np.cumsum(split) - split
        of = np.zeros(int(labels[-1] - labels[0]) + 1, dtype="int64") if k and labels[-1] - labels[0] < 1 << 20 else None
        if of is not None:
            of[labels - labels[0]] = np.arange(k)
        bounds = (np.arange(1, parts) * units + parts - 1) // parts * (span * k)

        def number(x: np.ndarray) -> np.ndarray:
            return np.searchsorted(labels, x) if of is None else of[x - int(labels[0])]

        def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            lo, hi, l_lo, l_hi = (np.concatenate(part) for part in zip(*held, strict=True))
            l_lo, l_hi = number(l_lo), number(l_hi)
            codes = []
            for v, c, x in ((lo - low, l_lo, l_hi), (hi - low, l_hi, l_lo)):
                unit = base[c]
                if units > k:
                    unit = unit + ((v.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("int64") % split[c]
                codes.append((unit * span + v) * k + x)
            codes = np.sort(np.concatenate(codes))
            ends = [0, *np.searchsorted(codes, bounds).tolist(), len(codes)]
            for t, (start, stop) in enumerate(zip(ends, ends[1:], strict=False)):
                if start < stop:
                    steps = np.diff(codes[start:stop])
                    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << 8 * w)
                    row = {"t": t, "first": int(codes[start]), "width": width, "data": steps.astype(f"u{width}").tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("t", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("data", pa.binary())]))

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy() for i in range(4)])
                n += b.num_rows
            if n >= CHUNK:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    return run


def _met(labels: np.ndarray, split: np.ndarray, span: int):
    """Packed numbers of a task to classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.cumsum(np.concatenate([[r["first"]], np.frombuffer(r["data"], dtype=f"u{r['width']}").astype("int64")])) for b in batches for r in b.to_pylist()]
        if held:
            codes = np.concatenate(held)
            held.clear()
            codes.sort()
            yield from _batches(_of_codes(codes, np.repeat(labels, split), labels, span))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
    if held:
        v, c, x = (np.concatenate(part) for part in zip(*held, strict=True))
        held.clear()
        yield from _batches(label_pairs(v, c, x))


def _batches(found: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for label, xs, ys, n in found:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label, dtype="int32")), pa.array(xs.astype("int32")), pa.array(ys.astype("int32")), pa.array(n)], names=["c", "x", "y", "support"])


def label_pairs(v: np.ndarray, c: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each label ``c``: arrays of x <= y and of how many pairs of neighbours have these labels, each x, y once."""
    labels, kinds = np.unique(c), np.unique(x)
    k, low = len(kinds), int(v.min())
    span = int(v.max()) - low + 1
    at, to = np.searchsorted(labels, c), np.searchsorted(kinds, x)
    if len(labels) * span * k >= 1 << 63:
        ids, v = np.unique(v, return_inverse=True)
        low, span = 0, len(ids)
    # One number for each row: the label, the vertex and the neighbour's label.
    codes = (at * span + (v - low)) * k + to
    codes.sort()
    return _of_codes(codes, labels, kinds, span)


def _of_codes(codes: np.ndarray, owners: np.ndarray, kinds: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """From sorted numbers (owner * span + vertex) * k + kind, what ``label_pairs`` gives; the label of each owner."""
    k = len(kinds)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    n = np.diff(first, append=len(codes))
    around, to = np.divmod(codes[first], k)
    # Rows of a vertex stand together; each meets itself and those after it.
    starts = np.flatnonzero(np.diff(around, prepend=-1))
    sizes = np.diff(starts, append=len(around))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(around))
    here = np.unique(around[starts] // span)
    bounds = np.searchsorted(around, [*(here * span).tolist(), int(around[-1]) + 1])
    for i, owner in enumerate(here.tolist()):
        code, total = _of_label(to, n, left, int(bounds[i]), int(bounds[i + 1]), k)
        yield int(owners[owner]), kinds[code // k], kinds[code % k], total


def _of_label(to: np.ndarray, n: np.ndarray, left: np.ndarray, start: int, stop: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes x * k + y and their sums for the rows from ``start`` to ``stop``."""
    ends = np.cumsum(left[start:stop])
    dense = np.zeros(k * k, dtype="int64") if k * k <= min(DENSE, 4 * int(ends[-1])) else None
    got, done, i, size = [], 0, start, stop - start
    while i < stop:
        j = start + min(size, max(i - start + 1, int(np.searchsorted(ends, done + CHUNK, side="right"))))
        many = left[i:j]
        here = int(ends[j - 1 - start])
        own = np.repeat(np.arange(i, j), many)
        other = own + np.arange(here - done) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.where(own == other, n[own] * (n[own] - 1) // 2, n[own] * n[other])
        code = to[own] * k + to[other]
        if dense is not None and float(pairs.sum(dtype="float64")) < 1 << 52:
            dense += np.bincount(code, weights=pairs, minlength=k * k).astype("int64")
        else:
            got.append(_reduced(code, pairs))
            if sum(len(g[0]) for g in got) > 8 * CHUNK:
                got = [_reduced(*(np.concatenate(g) for g in zip(*got, strict=True)))]
        i, done = j, here
    if dense is not None:
        code = np.flatnonzero(dense)
        got.append((code, dense[code]))
    code, total = _reduced(*(np.concatenate(g) for g in zip(*got, strict=True))) if len(got) > 1 else got[0]
    some = total > 0
    return code[some], total[some]


def _reduced(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first)
