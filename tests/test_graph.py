import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import components as component_plans
from graphloom.operators import relational, vertex
from graphloom.plans import algorithms
from graphloom.sources import layout, sinks, text


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def both(pairs):
    return [*pairs, *[(b, a) for a, b in pairs]]


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


# Readers and writers
def test_edge_list_file(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("# x\n5 5\n5\t9\n% y\n9,7 0.5\nbad line\n\n5 9\n")
    g = text.read_edge_list(spark, str(f))
    assert rows(g.edges) == [(0, 4), (0, 4), (4, 2)]
    assert g.dense_ids().count() == 5
    w = text.read_edge_list(spark, str(f), weighted=True, shift=False, drop_self_loops=False)
    assert sorted(((r.src, r.dst, r.weight) for r in w.edges.collect()), key=str) == [(5, 5, None), (5, 9, None), (5, 9, None), (9, 7, 0.5)]


def test_adjacency_file(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("2 300 4 3 4 2\n3 1\n\n5 7 2")
    g = text.read_adjacency(spark, str(f))
    assert rows(g.edges) == [(0, 1), (0, 2), (3, 0)]
    assert rows(g.vertices) == [(0, 44), (1, 1), (2, 0), (3, 7)]
    assert rows(g.labelled_edges()) == [(0, 1, 44, 1), (0, 2, 44, 0), (3, 0, 7, 44)]
    raw = text.read_adjacency(spark, str(f), wrap_labels=False, shift=False)
    assert rows(raw.vertices) == [(2, 300), (3, 1), (4, 0), (5, 7)]


def test_adjacency_file_with_edge_labels(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("0 1 1 8 2 9\n1 2\n2 3 0 9\n")
    g = text.read_adjacency(spark, str(f), edge_labels=True)
    assert rows(g.edges) == [(0, 1, 8), (0, 2, 9), (2, 0, 9)]
    assert rows(g.vertices) == [(0, 1), (1, 2), (2, 3)]


def test_dimacs_round_trip(spark, tmp_path):
    f = tmp_path / "d.txt"
    f.write_text("c star\np edge 4 3\nn 1 7\ne 1 2\ne 1 3\ne 1 4\n")
    g = text.read_dimacs(spark, str(f))
    assert g.edges.count() == 6
    lines = [r.value for r in sinks.dimacs_lines(g).collect()]
    assert lines == ["p edge 4 3", "n 1 7", "n 2 0", "n 3 0", "n 4 0", "e 1 2", "e 1 3", "e 1 4"]
    (tmp_path / "e.txt").write_text("\n".join(lines))
    again = text.read_dimacs(spark, str(tmp_path / "e.txt"))
    assert rows(again.edges) == rows(g.edges) and rows(again.vertices) == rows(g.vertices)
    assert [r.value for r in sinks.dot_lines(g).collect()][-2:] == ["v1 -- v4;", "}"]


def test_adjacency_text(spark, tmp_path):
    sinks.write_adjacency(edges(spark, [(1, 9), (1, 2), (1, 9), (3, 1)]), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 0 2 9", "3 0 1"]


def test_layout(spark, tmp_path):
    assert layout.vertex_ranges(0, 10, 3) == [(0, 2), (3, 5), (6, 10)]
    with pytest.raises(ValueError):
        layout.vertex_ranges(0, 1, 3)
    e = edges(spark, [(0, 1)] * 10 + [(i, 0) for i in range(1, 11)])
    parted, ranges = layout.partition_by_edges(e, 4)
    assert ranges[0] == (0, 0) and ranges[-1][1] == 10
    assert [r.n_edges for r in layout.describe(parted, ranges).orderBy("part").collect()] == [10, 5, 5]
    parted, ranges = layout.partition_by_range(e, 2)
    assert [r.n_edges for r in layout.describe(parted, ranges).orderBy("part").collect()] == [14, 6]
    layout.save(Graph(e), str(tmp_path / "g"))
    assert layout.load(spark, str(tmp_path / "g")).vertices is None
    assert rows(layout.load(spark, str(tmp_path / "g")).edges) == rows(e)


def test_from_edges_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (1, 2)], "a long, b long")
    assert rows(Graph.from_edges(df, "a", "b").edges) == [(1, 2)]
    assert rows(Graph.from_edges(df, "a", "b", drop_self_loops=False).edges) == [(1, 2), (3, 3)]


# Relational operators
def test_bag_operators(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "x long, y long")
    b = spark.createDataFrame([(1, None)], "x long, y long")
    assert rows(relational.difference(a, b)) == [(2, 5), (2, 5)]
    assert relational.append(a, b).count() == 5
    assert relational.remove_duplicates(a).count() == 2
    assert relational.row_count(a).first().n_rows == 4
    assert relational.has_ended(a.limit(0)) and not relational.has_ended(a)


def test_join_edges_multiplies_duplicates(spark):
    e = edges(spark, [(1, 2), (1, 2), (2, 3), (2, 1)])
    u = vertex.scatter(e, target=F.col("dst"), src=F.col("src"))
    out = relational.join_edges(u, e, lambda u, d: u("src") != d("dst"), lambda u, d: {"a": u("src"), "b": d("dst")})
    assert rows(out) == [(1, 3), (1, 3)]


# Vertex programs
def test_gather_keeps_vertices_without_updates(spark):
    v = spark.createDataFrame([(1, 10), (2, 20)], "id long, x long")
    u = spark.createDataFrame([(1, 5), (1, 7), (9, 1)], "target long, d long")
    out = vertex.gather(v, u, {"s": F.sum("d")}, {"x": F.col("x") + F.col("s")})
    assert rows(out) == [(1, 22), (2, 20)]


def test_init_and_degrees(spark):
    v = vertex.init_vertices((spark, 3), rank=F.lit(1.0))
    assert rows(vertex.with_degrees(v, edges(spark, [(0, 1), (0, 1)]))) == [(0, 1.0, 2), (1, 1.0, 0), (2, 1.0, 0)]
    u = vertex.scatter_updates(spark.createDataFrame([(1, 2)], "target long, x long"), target=F.col("x"))
    assert rows(u) == [(2,)]


def test_prune(spark):
    g = Graph(edges(spark, [(5, 9), (9, 5), (9, 7), (7, 8), (1, 5)]), spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, odd long"))
    out = vertex.prune_graph(g, F.col("odd") == 1)
    assert rows(out.edges) == [(0, 1), (1, 0), (1, 3), (2, 3), (3, 1), (3, 2)]
    assert rows(out.vertices.select("id", "old_id")) == [(0, 1), (1, 5), (2, 7), (3, 9)]
    assert vertex.prune_graph(g, F.lit(False)).edges.count() == 0


# Programs
@pytest.mark.parametrize(
    ("pairs", "n"),
    [
        (both([(0, 1), (1, 2), (0, 2)]), 1), ([(0, 1), (1, 2), (2, 0)], 1), ([(0, 2), (2, 1), (1, 0)], 0), ([(0, 1), (1, 2), (0, 2)], 0),
        ([*both([(0, 1), (1, 2), (0, 2)]), (0, 1)], 2), ([], 0), ([(1, 1)], 0),
    ],
)
def test_triangle_fixtures(spark, pairs, n):
    assert (algorithms.triangles(edges(spark, pairs)).agg(F.sum("n")).first()[0] or 0) == n


def test_triangles_against_brute_force(spark):
    pairs = random_pairs(1, 12, 90)
    want = {}
    for a, b in pairs:
        for b2, c in pairs:
            for c2, a2 in pairs:
                if b == b2 and c == c2 and a == a2 and a < b < c:
                    want[a, b, c] = want.get((a, b, c), 0) + 1
    assert {tuple(r)[:3]: r.n for r in algorithms.triangles(edges(spark, pairs)).collect()} == want


def reach(pairs):
    out = {p for p in pairs if p[0] != p[1]}
    while True:
        new = {(a, d) for a, b in out for c, d in out if b == c and a != d} - out
        if not new:
            return out
        out |= new


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 0)], [], random_pairs(2, 12, 16)])
def test_closure(spark, pairs):
    assert rows(algorithms.transitive_closure(edges(spark, pairs))) == sorted(reach(pairs))


def test_closure_of_a_bag(spark):
    assert algorithms.transitive_closure(edges(spark, [(0, 1), (0, 1), (1, 2)]), distinct_base=False).count() == 4


@pytest.mark.parametrize("mode", ["cumulative", "standard"])
def test_pagerank(spark, mode):
    pairs = [p for p in random_pairs(3, 8, 30) if p[0] != p[1]]
    ids = {x for p in pairs for x in p} | {99}
    rank, total = dict.fromkeys(ids, 1.0), dict.fromkeys(ids, 0.0)
    degree = {i: sum(a == i for a, _ in pairs) for i in ids}
    for _ in range(4):
        got = {}
        for a, b in pairs:
            got[b] = got.get(b, 0) + rank[a] / degree[a]
        for i, x in got.items():
            total[i] = total[i] + x if mode == "cumulative" else x
            rank[i] = 0.15 + 0.85 * total[i]
    g = Graph(edges(spark, pairs), spark.createDataFrame([(i,) for i in ids], "id long"))
    assert {r.id: r.rank for r in algorithms.pagerank(g, 4, mode).collect()} == pytest.approx(rank)
    with pytest.raises(ValueError):
        algorithms.pagerank(g, 1, "other")


def test_components(spark):
    pairs = random_pairs(5, 60, 45)
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in algorithms.components(Graph(edges(spark, pairs))).collect()} == {x: find(x) for x in root}
    chain = [(i, i + 1) for i in range(70)]
    assert {r.component for r in algorithms.components(Graph(edges(spark, chain))).collect()} == {0}
    assert rows(algorithms.components_rounds(Graph(edges(spark, [(0, 1), (1, 2), (2, 3)])), 2)) == [(0, 0), (1, 0), (2, 0), (3, 1)]


@pytest.mark.parametrize("sizes", [{}, {"small": 0}, {"small": 0, "limit": 3}, {"small": 40}])
def test_components_of_a_hard_path(spark, sizes, monkeypatch):
    # 0, n, n - 1, ..., 1: the least label is far from all others but one.
    n, cuts = 400, []
    path = [0, *range(n, 0, -1)]
    monkeypatch.setattr(component_plans.Workspace, "cut", lambda self, df, f=component_plans.Workspace.cut: cuts.append(1) or f(self, df))
    got = algorithms.components(Graph(edges(spark, list(zip(path, path[1:], strict=False)))), **sizes).collect()
    assert len(got) == n + 1 and {r.component for r in got} == {0}
    # Rounds are at most log2 n, and so are the doubling steps of each.
    assert len(cuts) <= 2 * math.log2(n) * (1 if sizes.get("small", 1) else 2)


@pytest.mark.parametrize("limit", [1, 10**6])
def test_path_counts(spark, limit, monkeypatch):
    pairs = random_pairs(8, 10, 60)
    want = {}
    for a, b in pairs:
        for c, d in pairs:
            if a != b and b == c and c != d and a != d:
                want[a] = want.get(a, 0) + 1
    assert dict(rows(algorithms.path_counts(edges(spark, pairs)))) == want


def test_long_closure(spark):
    chain = edges(spark, [(i, i + 1) for i in range(40)] + [(7, 3)])
    assert rows(algorithms.transitive_closure(chain)) == sorted(reach([(i, i + 1) for i in range(40)] + [(7, 3)]))
    assert algorithms.transitive_closure(edges(spark, [(i, i + 1) for i in range(5)]), max_rounds=1).count() == 9


def test_weights_are_finite_decimal_numbers(spark):
    lines = spark.createDataFrame([("1 2 3f",), ("1 2 nan",), ("1 2 1e39",), ("1 2 .5",), ("1 2 2.",), ("1 2",)], "value string")
    assert sorted((r.weight for r in text.parse_edge_list(lines, weighted=True).collect()), key=str) == [0.5, 2.0, None, None, None, None]


def test_sparse_ids_are_not_filled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 5 4000000000\n")
    assert rows(text.read_adjacency(spark, str(tmp_path / "a.txt")).vertices) == [(0, 5), (3999999999, 0)]
    (tmp_path / "b.txt").write_text("1 5 400\n")
    assert text.read_adjacency(spark, str(tmp_path / "b.txt"), fill_gaps=True).vertices.count() == 400
