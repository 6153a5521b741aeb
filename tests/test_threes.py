"""Subgraphs of three vertices: none of them is written, and all come out."""

from itertools import combinations

import pytest

from graphloom.graph import Graph
from graphloom.operators import mining, threes
from graphloom.plans import algorithms
from graphloom.runtime import Workspace

HUB = [(0, i) for i in range(1, 61)] + [(1, 2), (1, 3), (2, 3), (4, 5)]


def graph(spark, pairs, labels=None):
    e = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "src long, dst long")
    return Graph(e, spark.createDataFrame([(i, (labels or {}).get(i, 0)) for i in {x for p in pairs for x in p}], "id long, label int"))


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written."""
    rows, cut = [], Workspace.cut

    def counted(self, df):
        back = cut(self, df)
        rows.append(back.count())
        return back

    monkeypatch.setattr(Workspace, "cut", counted)
    return rows


@pytest.mark.parametrize(("mode", "filter_last"), [("exact", True), ("parity", False)])
def test_frequent_subgraphs_write_no_subgraphs(spark, written, mode, filter_last):
    got = algorithms.frequent_subgraphs(graph(spark, HUB), 3, 2, mode=mode, filter_last=filter_last)
    assert {n: [r.support for r in c.collect()] for n, (c, _) in got.items()} == {1: [64], 2: [60 * 59 // 2 + 3 + 3 * 2 + 2], 3: [5]}
    assert max(written) <= 2 * len(HUB)
    assert {n: k.count() for n, (_, k) in got.items()} == {1: 64, 2: 1781, 3: 5}


def test_wedges_and_triangles_are_the_tuples_of_the_rule(spark):
    pairs = [p for p in combinations((7, 3, 9, 1, 5, 8), 2) if sum(p) % 5]
    edges = graph(spark, pairs, {7: 2, 1: 1, 8: 1}).labelled_edges()
    two = mining.expand(mining.init(edges), edges, 3)
    three = mining.expand(two, edges, 3)
    work = Workspace(spark, "test")
    for tile in (1, 4096):
        assert sorted(map(str, threes.wedge_tuples(threes.wedges(edges, tile)).collect())) == sorted(map(str, two.collect()))
    assert sorted(map(str, threes.triangle_tuples(threes.triangles(edges, work)).collect())) == sorted(map(str, three.collect()))


def test_motifs_write_no_subgraphs(spark, written):
    got = algorithms.motif_levels(graph(spark, HUB), 3)
    assert {n: level.count() for n, level in got.items()} == {2: 1781, 3: 5}
    assert max(written) <= 2 * len(HUB)


def test_general_cliques_read_only_levels_that_can_be_complete(spark, written):
    found = algorithms.general_cliques(graph(spark, HUB), 3)
    assert sorted(tuple(r.members) for r in found.collect()) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 4, 5), (1, 2, 3)]
    assert max(written) <= 2 * len(HUB)
    # Wedges are never complete: the plan doesn't build them.
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fused_growth_goes_on_only_where_it_can(spark, written):
    g = graph(spark, HUB)
    edges = mining.by_degree(g.labelled_edges())
    grown = mining.expand_at(mining.shuffle_by_vertex(mining.init(edges)), edges, 3)
    assert grown.count() == 1781
    keyed = mining.by_vertex_growing(grown, 3)
    # One for each wedge at the least vertex, here one for each triangle, not three for each wedge.
    assert keyed.count() == 5
    assert mining.expand_at(keyed, edges, 3).count() == 5


def test_growing_vertices_lose_no_tuple(spark):
    pairs = [p for p in combinations(range(8), 2) if (p[0] * 5 + p[1] * 3) % 4]
    edges = graph(spark, pairs).labelled_edges()
    level = mining.init(edges)
    for _ in range(3):
        grown = mining.expand_at(mining.by_vertex(level), edges, 4)
        some = mining.expand_at(mining.by_vertex(level), edges, 4, growing=True)
        want = mining.expand_at(mining.by_vertex(grown), edges, 4)
        got = mining.expand_at(mining.by_vertex_growing(some, 4), edges, 4)
        assert want.count() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        level = grown


def test_numbers_by_degree(spark):
    edges = mining.by_degree(graph(spark, HUB).labelled_edges()).collect()
    degree = {}
    for r in edges:
        degree[r.src] = degree.get(r.src, 0) + 1
    order = [degree[x] for x in sorted(degree)]
    assert len(edges) == 2 * len(HUB) and order == sorted(order) and order[-1] == 60


def test_general_cliques_grow_only_what_may_be_complete(spark, written):
    pairs = [*HUB, *[p for p in combinations(range(70, 76), 2)], (75, 80)]
    have = set(pairs)
    want = sorted(c for k in (3, 4, 5) for c in combinations(sorted({x for p in pairs for x in p}), k) if all(p in have for p in combinations(c, 2)))
    assert sorted(tuple(r.members) for r in algorithms.general_cliques(graph(spark, pairs), 5).collect()) == want
    # Wedges alone are more than 1770.
    assert max(written) < 400


def test_shuffled_levels_send_only_what_may_grow(spark, monkeypatch):
    sent, growing = [], mining.by_vertex_growing

    def counted(tuples, most):
        out = growing(tuples, most)
        sent.append((out.count(), mining.by_vertex(tuples).count()))
        return out

    monkeypatch.setattr(mining, "by_vertex_growing", counted)
    pairs = [p for p in combinations(range(7), 2) if (p[0] * 5 + p[1] * 3) % 4]
    levels = algorithms.motif_levels(graph(spark, pairs), 4, dedupe="rule", shuffled=True)
    want = algorithms.motif_levels(graph(spark, pairs), 4, dedupe="rule")
    assert {n: x.count() for n, x in levels.items()} == {n: x.count() for n, x in want.items()}
    assert len(sent) == 3 and sent[-1][0] < sent[-1][1] // 2
