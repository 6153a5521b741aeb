"""Reachability inside weakly connected components of bounded size.

A task gets all edges of its components. Vertices that reach each other (Tarjan's
components) count as one; they come out in an order in which edges lead back, so one pass over the
edges gives for each the set of those it reaches, as bits of an integer. The bits are worked out for ``BLOCK`` targets at a time,
so memory goes with the number of edges and not with the number of pairs, and large components share their blocks among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Targets whose bits are held at a time; pairs in a batch that is handed on.
BLOCK, BATCH = 4096, 1 << 18


def strong(starts: list[int], ends: list[int], n: int) -> tuple[list[int], int]:
    """For each of the vertices 0 .. n-1 the number of its strong component, and how many there are. Edges between components lead to smaller numbers.

    ``ends[starts[v] : starts[v + 1]]``: where the edges of v lead.
    """
    index, low, of, count, seen = [-1] * n, [0] * n, [-1] * n, 0, 0
    stack: list[int] = []
    at = starts[:]
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = seen
                seen += 1
                stack.append(v)
            deeper = False
            while at[v] < starts[v + 1]:
                w = ends[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                    deeper = True
                    break
                if of[w] < 0:
                    low[v] = min(low[v], index[w])
            if deeper:
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    of[w] = count
                    if w == v:
                        break
                count += 1
    return of, count


def reachable(src: np.ndarray, dst: np.ndarray, part: int = 0, parts: int = 1, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of pairs x, y with y != x reachable from x, each once. Of several parts, every part gets its own blocks of targets."""
    ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = both[: len(src)], both[len(src) :]
    n, order = len(ids), np.argsort(a, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    of, count = strong(starts.tolist(), b[order].tolist(), n)
    of = np.array(of)
    by = np.argsort(of, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))])
    sizes, members = np.diff(first), ids[by]
    links = np.unique(np.stack([of[a], of[b]], axis=1)[of[a] != of[b]], axis=0)
    tails, heads = links[:, 0].tolist(), links[:, 1].tolist()
    whole = (sizes > 1).tolist()
    for low in range(part * block, count, parts * block):
        top = min(low + block, count)
        bits = [0] * count
        k, m = int(np.searchsorted(links[:, 0], low)), len(tails)
        # Nothing below the block reaches into it.
        for x in range(low, count):
            r = 1 << (x - low) if x < top and whole[x] else 0
            while k < m and tails[k] == x:
                h = heads[k]
                k += 1
                if h >= low:
                    r |= bits[h]
                    if h < top:
                        r |= 1 << (h - low)
            if not r:
                continue
            bits[x] = r
            if r & (r - 1):
                met = np.flatnonzero(np.unpackbits(np.frombuffer(r.to_bytes(block // 8 + 1, "little"), dtype=np.uint8), bitorder="little")) + low
            else:
                met = np.array([r.bit_length() - 1 + low])
            n_each = sizes[met]
            total = int(n_each.sum())
            there = members[np.repeat(first[met] - np.concatenate([[0], np.cumsum(n_each)[:-1]]), n_each) + np.arange(total)] if total > len(met) else members[first[met]]
            for v in members[first[x] : first[x + 1]]:
                y = there[there != v] if whole[x] and x < top else there
                yield np.full(len(y), v), y


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: edges ``src, dst, part, parts`` of whole components to pairs ``src, dst``."""
    read = [x for x in rows if x.num_rows]
    if not read:
        return
    table = pa.Table.from_batches(read)
    src, dst, part, parts = (table[c].to_numpy() for c in ("src", "dst", "part", "parts"))
    of = parts.astype("int64") << 32 | part
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in (0, 1)], names=["src", "dst"])

    for x in np.unique(of):
        here = of == x
        for pair in reachable(src[here], dst[here], int(x & 0xFFFFFFFF), int(x >> 32)):
            held.append(pair)
            n += len(pair[0])
            if n >= BATCH:
                yield out()
                held, n = [], 0
    if held:
        yield out()
