"""Classes of tuples that grow by the ordering rule, counted without building their wedges."""

import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import label_pairs, threes
from graphloom.plans import algorithms, counting


def graph(spark, pairs, labels):
    e = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "src long, dst long")
    return Graph(e, spark.createDataFrame([(i, labels.get(i, 0)) for i in {x for p in pairs for x in p}], "id long, label int"))


def rows(levels):
    return {n: sorted(tuple(r) for r in c.collect()) for n, c in levels.items()}


@pytest.mark.parametrize(("seed", "levels", "filter_last", "limits"), [(1, 2, False, {}), (2, 3, False, {"limit": 3, "rows": 5}), (3, 3, True, {"most_labels": 0})])
def test_as_the_subgraphs_that_are_built(spark, seed, levels, filter_last, limits):
    r = random.Random(seed)
    ids = [-5, 0, 3, 1 << 40, *range(10, 22)]
    pairs = [p for p in combinations(r.sample(ids, len(ids)), 2) if r.random() < 0.4]
    g = graph(spark, pairs, {i: r.choice((-1, 0, 2, 2, 300)) for i in ids})
    want = rows({n: c for n, (c, _) in algorithms.frequent_subgraphs(g, 3, 5, mode="parity", levels=levels, filter_last=filter_last).items()})
    assert rows(counting.rule_counts(g, levels, 5, filter_last, **limits)) == want and want[1] and want[2]


def test_wedges_of_hubs_are_not_built(spark, monkeypatch):
    def built(*_):
        raise AssertionError("wedges are built")

    monkeypatch.setattr(threes, "wedges", built)
    n = 30_000
    g = graph(spark, [(0, i) for i in range(1, n + 1)], {i: i % 2 for i in range(n + 1)})
    got = rows(algorithms.frequent_counts(g, 3, 15, mode="parity", levels=3, filter_last=False))
    half = n // 2
    assert got[2] == [("0 0 0|0-1 0-2", 3, 2, half * (half - 1) // 2), ("0 0 1|0-1 0-2", 3, 2, half * half), ("0 1 1|0-1 0-2", 3, 2, half * (half - 1) // 2)]
    assert got[3] == []


def test_query_builds_no_wedges(spark, monkeypatch):
    from graphloom.plans.graph_queries import QUERIES

    monkeypatch.setattr(threes, "wedges", lambda *_: pytest.fail("wedges are built"))
    assert QUERIES["fsm_k3_unfiltered"](spark, "/root/testdata/sf0.001").where("n_edges = 1").count() >= 0


@pytest.mark.parametrize("chunk", [4, 1 << 20])
@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_label_pairs(monkeypatch, chunk, dense):
    monkeypatch.setattr(label_pairs, "CHUNK", chunk)
    monkeypatch.setattr(label_pairs, "DENSE", dense)
    r = np.random.default_rng(5)
    v = r.integers(-(1 << 62), 1 << 62, 9)[r.integers(0, 9, 200)]
    c, x = (v % 3).astype("int32"), r.integers(-2, 5, 200).astype("int32")
    want: dict[tuple[int, ...], int] = {}
    for a, b in combinations(range(200), 2):
        if v[a] == v[b]:
            key = (int(c[a]), *sorted((int(x[a]), int(x[b]))))
            want[key] = want.get(key, 0) + 1
    got = [(k, int(i), int(j), int(n)) for k, xs, ys, ns in label_pairs.label_pairs(v, c, x) for i, j, n in zip(xs, ys, ns, strict=True)]
    assert len(got) == len(want) and {k[:3]: k[3] for k in got} == want


@pytest.mark.parametrize(("low", "most"), [(-5, 3), (-5, 1000), (-(1 << 62), 1000)])
def test_edges_are_packed_on_their_way(spark, low, most):
    pairs = [(-5, 1, 0, 7), (-5, 2, 0, 7), (-5, 9, 0, -1), (1, 2, 7, 7), (2, 9, 7, -1)]
    edges = spark.createDataFrame(pairs, "lo long, hi long, l_lo int, l_hi int")
    got = label_pairs.edge_pair_counts(edges, {0: 3, 7: 5, -1: 2}, low, 1 << 62 if low < -5 else 9, most)
    assert sorted(tuple(r) for r in got.collect()) == [(-1, 0, 7, 1), (0, -1, 7, 2), (0, 7, 7, 1), (7, -1, 0, 1), (7, -1, 7, 1), (7, 0, 7, 2)]
