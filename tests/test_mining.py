import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.functions.canonical import automorphisms, canonical_code
from graphloom.graph import Graph
from graphloom.operators import mining, patterns
from graphloom.plans import algorithms


def graph(spark, pairs, labels=None):
    e = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "src long, dst long")
    ids = {x for p in pairs for x in p}
    return Graph(e, spark.createDataFrame([(i, (labels or {}).get(i, 0)) for i in ids], "id long, label int"))


def random_graph(seed, n=7, p=0.45):
    rng = random.Random(seed)
    pairs = [x for x in combinations(range(n), 2) if rng.random() < p]
    return pairs or [(0, 1)], {i: rng.randrange(3) for i in range(n)}


def connected(es):
    left = list(es[1:])
    seen = set(es[0])
    while left:
        hit = next((e for e in left if seen & set(e)), None)
        if hit is None:
            return False
        seen |= set(hit)
        left.remove(hit)
    return True


def brute(pairs, n_edges, max_vertices):
    return {es for es in combinations(sorted(pairs), n_edges) if connected(es) and len({x for e in es for x in e}) <= max_vertices}


def code(es, labels):
    ids = sorted({x for e in es for x in e})
    number = {x: i for i, x in enumerate(ids)}
    return canonical_code(tuple(labels.get(x, 0) for x in ids), tuple((number[a], number[b]) for a, b in es))


def sets(df):
    return Counter(tuple(sorted((e.lo, e.hi) for e in r.e)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_subgraphs_against_brute_force(spark, seed):
    pairs, _ = random_graph(seed)
    g = graph(spark, pairs)
    for n, level in algorithms.motif_levels(g, 4, 5).items():
        got = sets(level)
        assert set(got) == brute(pairs, n, 4) and all(c == 1 for c in got.values())
    for n, level in algorithms.motif_levels(g, 4, 5, dedupe="rule").items():
        got = sets(level)
        assert set(got) == brute(pairs, n, 4)
        assert n > 3 or all(c == 1 for c in got.values())


@pytest.mark.parametrize(("pairs", "n"), [([(0, 2), (0, 3), (1, 2), (1, 3)], 2), ([(0, 1), (1, 2), (2, 3), (0, 3)], 1)])
def test_squares_by_numbering(spark, pairs, n):
    g = graph(spark, pairs)
    assert sum(sets(algorithms.motif_levels(g, 4, 4, dedupe="rule")[4]).values()) == n
    assert sum(sets(algorithms.motif_levels(g, 4, 4)[4]).values()) == 1


def test_shuffled_growth_gives_the_same_tuples(spark):
    pairs, labels = random_graph(11)
    e = graph(spark, pairs, labels).labelled_edges()
    t = mining.init(e)
    for _ in range(3):
        a, b = mining.expand(t, e, 4), mining.expand_at(mining.shuffle_by_vertex(t), e, 4)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
        t = a


def test_columns_of_tuples(spark):
    pairs, labels = random_graph(12)
    e = graph(spark, pairs, labels).labelled_edges()
    for r in mining.expand(mining.expand(mining.expand(mining.init(e), e, 4), e, 4), e, 4).collect():
        order = list(dict.fromkeys(r.v))
        assert r.q == [order.index(x) + 1 for x in r.v] and r.n == len(order) and r.l == [labels[x] for x in r.v]
        assert [(x.lo, x.hi) for x in r.e] == [tuple(sorted((r.v[r.h[j]], r.v[j]))) for j in range(1, len(r.v))]


@pytest.mark.parametrize("labelled", [False, True])
def test_pattern_counts(spark, labelled):
    pairs, labels = random_graph(5)
    g = graph(spark, pairs, labels)
    for n, level in algorithms.motif_levels(g, 4).items():
        want = Counter(code(es, labels if labelled else {}) for es in brute(pairs, n, 4))
        assert {r.pattern: r.support for r in patterns.count_patterns(level, labelled).collect()} == want


def exact_fsm(pairs, labels, k, support):
    kept, out = None, {}
    for n in range(1, k + 1):
        cands = brute(pairs, n, k)
        if kept is not None:
            cands = {es for es in cands if any(tuple(x for x in es if x != e) in kept for e in es)}
        counts = Counter(code(es, labels) for es in cands)
        frequent = {p: c for p, c in counts.items() if c >= support}
        kept = {es for es in cands if code(es, labels) in frequent}
        out[n] = frequent
    return out


@pytest.mark.parametrize("seed", [21, 22])
def test_frequent_subgraphs(spark, seed):
    pairs, labels = random_graph(seed, 8)
    got = algorithms.frequent_subgraphs(graph(spark, pairs, labels), 3, 3)
    assert {n: {r.pattern: r.support for r in c.collect()} for n, (c, _) in got.items()} == exact_fsm(pairs, labels, 3, 3)
    # Another numbering of the vertices changes nothing.
    to = dict(zip(range(8), random.Random(seed).sample(range(50, 90), 8), strict=True))
    again = algorithms.frequent_subgraphs(graph(spark, [(to[a], to[b]) for a, b in pairs], {to[i]: x for i, x in labels.items()}), 3, 3)
    assert {n: {tuple(r) for r in c.collect()} for n, (c, _) in got.items()} == {n: {tuple(r) for r in c.collect()} for n, (c, _) in again.items()}


def parity_fsm(pairs, labels, k, support):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, out = [((a, b), (0, 0)) for a, b in sorted(tuple(sorted(p)) for p in pairs)], {}
    for n in range(1, k + 1):
        if n > 1:
            grown = []
            for v, h in level:
                made = [tuple(sorted((v[h[j]], v[j]))) for j in range(1, len(v))]
                for i, u in enumerate(v):
                    if v.index(u) != i:
                        continue
                    for w in near[u]:
                        new = tuple(sorted((u, w)))
                        if len({*v, w}) <= k and w >= v[0] and w != v[h[i]] and not (w in v and u > w) and all(new > made[j - 1] for j in range(i + 1, len(v))):
                            grown.append(((*v, w), (*h, i)))
            level = grown
        codes = [code([tuple(sorted((v[h[j]], v[j]))) for j in range(1, len(v))], labels) for v, h in level]
        counts = Counter(codes)
        out[n] = {p: c for p, c in counts.items() if c >= support}
        level = [t for t, c in zip(level, codes, strict=True) if c in out[n]]
    return out


def test_frequent_subgraphs_as_tuples_grow(spark):
    pairs, labels = random_graph(31, 8)
    got = algorithms.frequent_subgraphs(graph(spark, pairs, labels), 3, 3, mode="parity")
    assert {n: {r.pattern: r.support for r in c.collect()} for n, (c, _) in got.items()} == parity_fsm(pairs, labels, 3, 3)


@pytest.mark.parametrize("counting", [False, True])
def test_cliques_of_a_predicate(spark, counting):
    g = graph(spark, list(combinations(range(6), 2)))
    levels = algorithms.k_cliques(g.edges, 4, counting, keep=~F.array_contains("members", F.lit(3).cast("long")))
    assert sorted(tuple(r.members) for r in levels[4].collect()) == list(combinations((0, 1, 2, 4, 5), 4))


@pytest.mark.parametrize("counting", [False, True])
def test_cliques(spark, counting):
    pairs, _ = random_graph(41, 9, 0.7)
    have = {tuple(sorted(p)) for p in pairs}
    for k, df in algorithms.k_cliques(graph(spark, pairs).edges, 5, counting).items():
        want = sorted(c for c in combinations(range(9), k) if all(p in have for p in combinations(c, 2)))
        assert sorted(tuple(r.members) for r in df.collect()) == want
    with pytest.raises(ValueError):
        algorithms.k_cliques(graph(spark, pairs).edges, 1)


def test_general_cliques(spark):
    g = graph(spark, list(combinations(range(5), 2)))
    got = [tuple(r.members) for r in algorithms.general_cliques(g, 4).collect()]
    assert sorted(got) == sorted([*combinations(range(5), 3), *combinations(range(5), 4)])


def test_ranked_cliques(spark):
    star = [(i, 0) for i in range(1, 9)] + [(0, 1), (1, 2), (2, 0), (0, 2), (2, 1), (1, 0)]
    e = spark.createDataFrame(star, "src long, dst long")
    levels = algorithms.ranked_cliques(Graph(e), 1.5, 3)
    assert [tuple(r.members) for r in levels[3].collect()] == [(0, 1, 2)]


# Canonical codes
def test_codes_of_paths_and_stars():
    path = [((0, 0, 0), ((0, 2), (1, 2))), ((0, 0, 0), ((0, 1), (1, 2))), ((0, 0, 0), ((0, 1), (0, 2)))]
    assert len({canonical_code(*p) for p in path}) == 1
    assert canonical_code((0,) * 4, ((0, 1), (0, 2), (0, 3))) != canonical_code((0,) * 4, ((0, 1), (1, 2), (2, 3)))
    abc = [((1, 2, 3), ((0, 1), (0, 2))), ((3, 1, 2), ((0, 1), (1, 2))), ((2, 3, 1), ((0, 2), (1, 2)))]
    assert len({canonical_code(*p) for p in abc}) == 1
    assert canonical_code((1, 1, 2), ((0, 1), (0, 2))) != canonical_code((1, 1, 2), ((0, 2), (1, 2)))


@pytest.mark.parametrize("max_vertices", [3, 4])
def test_counts_without_building(spark, max_vertices):
    for seed in (51, 52):
        pairs, _ = random_graph(seed, 9)
        want = Counter(code(es, {}) for n in range(2, max_vertices + 1) for es in brute(pairs, n, max_vertices))
        assert {r.pattern: r.support for r in algorithms.motif_counts(graph(spark, pairs), max_vertices).collect()} == want


@pytest.mark.parametrize("seed", [61, 62])
def test_frequent_counts_without_building(spark, seed):
    pairs, labels = random_graph(seed, 9)
    got = algorithms.frequent_counts(graph(spark, pairs, labels), 3, 3)
    assert {n: {r.pattern: r.support for r in c.collect()} for n, c in got.items()} == exact_fsm(pairs, labels, 3, 3)


def test_labels_of_edges(spark):
    pairs, _ = random_graph(71, 6)
    kind = {p: (p[0] * 7 + p[1]) % 2 for p in pairs}
    e = spark.createDataFrame([(a, b, kind[a, b]) for a, b in pairs] + [(b, a, kind[a, b]) for a, b in pairs], "src long, dst long, edge_label int")
    g = Graph(e, spark.createDataFrame([(i, 0) for i in range(6)], "id long, label int"))
    for shuffled in (False, True):
        for n, level in algorithms.motif_levels(g, 4, 3, shuffled=shuffled).items():
            want = Counter()
            for es in brute(pairs, n, 4):
                ids = sorted({x for p in es for x in p})
                want[canonical_code((0,) * len(ids), tuple((ids.index(a), ids.index(b)) for a, b in es), tuple(kind[p] for p in es))] += 1
            assert {r.pattern: r.support for r in patterns.count_patterns(level, labelled=True).collect()} == want


def test_fused_shuffled_growth(spark):
    pairs, labels = random_graph(13)
    e = graph(spark, pairs, labels).labelled_edges()
    keyed = mining.expand_and_shuffle(mining.shuffle_by_vertex(mining.init(e)), e, 4)
    want = mining.by_vertex(mining.expand(mining.init(e), e, 4))
    assert sorted(map(str, keyed.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_growth_cut_into_parts(spark):
    pairs, labels = random_graph(14)
    e = graph(spark, pairs, labels).labelled_edges()
    t = mining.expand(mining.init(e), e, 4)
    hot = mining.hot_vertices(t, e, limit=4, tile=2)
    assert hot is not None
    a, b = mining.expand(t, e, 4), mining.expand(t, e, 4, hot=hot)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("n", [4, 6, 10])
def test_codes_do_not_depend_on_numbering(n):
    rng = random.Random(n)
    for _ in range(10):
        es = [x for x in combinations(range(n), 2) if rng.random() < 0.4]
        labels = [rng.randrange(2) for _ in range(n)] if n < 10 else [i // 3 for i in range(n)]
        p = rng.sample(range(n), n)
        moved = [0] * n
        for i, x in enumerate(labels):
            moved[p[i]] = x
        assert canonical_code(tuple(labels), tuple(es)) == canonical_code(tuple(moved), tuple(tuple(sorted((p[a], p[b]))) for a, b in es))


def test_codes_of_large_graphs_are_quick():
    began = time.time()
    for n in (8, 9):
        assert canonical_code((0,) * n, tuple(combinations(range(n), 2))).count("-") == n * (n - 1) // 2
        assert canonical_code((0,) * n, tuple((i, (i + 1) % n) for i in range(n))).startswith("0 " * (n - 1))
    assert time.time() - began < 0.4


def test_codes_with_labels_of_edges():
    path = ((0, 1), (1, 2))
    assert canonical_code((0, 0, 0), path, (1, 2)) == canonical_code((0, 0, 0), path, (2, 1)) == "0 0 0|0-1:1 0-2:2"
    assert canonical_code((0, 0, 0), path, (1, 1)) != canonical_code((0, 0, 0), path, (1, 2))
    assert len(automorphisms((0, 0, 0), path, (1, 2))) == 1 and len(automorphisms((0, 0, 0), path, (1, 1))) == 2


def test_automorphisms():
    assert len(automorphisms((0,) * 4, ((0, 1), (1, 2), (2, 3), (0, 3)))) == 8
    assert automorphisms((0, 0, 1), ((0, 2), (1, 2))) == [(0, 1, 2), (1, 0, 2)]


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long, label int"))
    assert algorithms.motif_counts(g, 3).count() == 0
    assert algorithms.k_cliques(g.edges, 3)[3].count() == 0
    assert mining.collect(mining.init(g.labelled_edges()), F.lit(True)).count() == 0
