"""Canonical codes of small coloured graphs.

A code is the colours in ascending order and the least edge list that some
numbering with this order gives: ``"0 0 7|0-1 1-2"``, with labels of edges ``"0 0 7|0-1:3 1-2:5"``. Two graphs have one code
exactly if they are isomorphic. Used on distinct patterns only, which are few
beside the subgraphs they stand for.

The least edge list is the greatest upper triangle of the adjacency matrix, read row by
row. Vertices are numbered one after the other from the first cell of an ordered
partition, which begins with the colours; each numbered vertex splits every cell into its neighbours and the
others. Only the numberings whose rows so far are the greatest go on. Of vertices that can
be exchanged (twins) one is tried, and of numberings that leave the same cells one goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

Edges = tuple[tuple[int, int], ...]


def _near(n: int, edges: Edges, edge_labels: Sequence[int] | None) -> list[dict[int, int]]:
    """For each vertex its neighbours with the label of the edge, 0 where there is none."""
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), x in zip(edges, edge_labels or [0] * len(edges), strict=True):
        near[a][b] = near[b][a] = x
    return near


def _cells(labels: Sequence[int]) -> tuple[tuple[int, ...], ...]:
    groups: dict[int, list[int]] = {}
    for v, x in enumerate(labels):
        groups.setdefault(x, []).append(v)
    return tuple(tuple(groups[x]) for x in sorted(groups))


def _split(cells: tuple[tuple[int, ...], ...], v: int, near: dict[int, int], kinds: Sequence[int]) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """(row of ``v``: neighbours in each cell by kind of edge, the cells without ``v`` split by it)."""
    row, out = [], []
    for cell in cells:
        rest = [w for w in cell if w != v]
        for kind in kinds:
            part = tuple(w for w in rest if near.get(w) == kind)
            row.append(len(part))
            if part:
                out.append(part)
        if part := tuple(w for w in rest if w not in near):
            out.append(part)
    return tuple(row), tuple(out)


def canonical_order(labels: Sequence[int], edges: Edges, edge_labels: Sequence[int] | None = None) -> tuple[int, ...]:
    """The vertices in the order of their canonical numbers."""
    near = _near(len(labels), edges, edge_labels)
    kinds = sorted(set(edge_labels or [0]))

    def twins(u: int, v: int) -> bool:
        return {w: x for w, x in near[u].items() if w != v} == {w: x for w, x in near[v].items() if w != u}

    states: dict[tuple[tuple[int, ...], ...], tuple[int, ...]] = {_cells(labels): ()}
    for _ in labels:
        best: tuple[int, ...] | None = None
        after: dict[tuple[tuple[int, ...], ...], tuple[int, ...]] = {}
        for cells, order in states.items():
            tried: list[int] = []
            for v in cells[0]:
                if any(twins(u, v) for u in tried):
                    continue
                tried.append(v)
                row, rest = _split(cells, v, near[v], kinds)
                if best is None or row > best:
                    best, after = row, {}
                if row == best:
                    after.setdefault(rest, (*order, v))
        states = after
    return next(iter(states.values()))


def canonical_code(labels: tuple[int, ...], edges: Edges, edge_labels: Sequence[int] | None = None) -> str:
    """The code of a graph with vertices 0 .. n-1 of these labels and these undirected edges, each given once."""
    number = {v: i for i, v in enumerate(canonical_order(labels, edges, edge_labels))}
    ends = sorted((*sorted((number[a], number[b])), *((x,) if edge_labels else ())) for (a, b), x in zip(edges, edge_labels or edges, strict=True))
    return " ".join(map(str, sorted(labels))) + "|" + " ".join(f"{e[0]}-{e[1]}" + (f":{e[2]}" if edge_labels else "") for e in ends)


def automorphisms(labels: tuple[int, ...], edges: Edges, edge_labels: Sequence[int] | None = None) -> list[tuple[int, ...]]:
    """All numberings of a small graph onto itself, the identity first in order.

    Vertices are given their images one after the other; an image must have the label and degree and agree on all edges so far.
    """
    near = _near(len(labels), edges, edge_labels)
    out: list[tuple[int, ...]] = []

    def extend(to: tuple[int, ...]) -> None:
        v = len(to)
        if v == len(labels):
            out.append(to)
            return
        for w in range(len(labels)):
            if w not in to and labels[w] == labels[v] and len(near[w]) == len(near[v]) and all(near[v].get(u) == near[w].get(x) for u, x in enumerate(to)):
                extend((*to, w))

    extend(())
    return out


def parts_of_code(code: str) -> tuple[tuple[int, ...], Edges, tuple[int, ...] | None]:
    """Labels, edges and labels of edges of a canonical code."""
    labels, _, ends = code.partition("|")
    pairs = [e.partition(":") for e in ends.split()]
    edges = tuple((int(a), int(b)) for a, b in (p[0].split("-") for p in pairs))
    return tuple(int(x) for x in labels.split()), edges, tuple(int(p[2]) for p in pairs) if pairs and pairs[0][1] else None


def code_of_quick(quick: str) -> str:
    """The canonical code of a quick pattern (see ``operators.mining.quick_pattern``)."""
    ids, history, *given = quick.split("|")
    at, back = [int(x) for x in ids.split(",")], [int(x) for x in history.split(",")]
    labels = [int(x) for x in given[0].split(",")] if given else [0] * len(at)
    kinds = [int(x) for x in given[1].split(",")] if len(given) > 1 else None
    edges = {tuple(sorted((at[back[j]] - 1, at[j] - 1))): kinds[j] if kinds else 0 for j in range(1, len(at))}
    label_of = {i - 1: x for i, x in zip(at, labels, strict=True)}
    return canonical_code(tuple(label_of[v] for v in range(len(label_of))), tuple(edges), tuple(edges.values()) if kinds else None)
