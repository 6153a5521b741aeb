"""Closure of components that are finished in one task, and of those that are not."""

import random

import numpy as np
import pytest

from graphloom.operators import closure
from graphloom.plans import algorithms


def reach(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = set()
    for x in near:
        todo, seen = [x], set()
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(x, y) for y in seen if y != x}
    return sorted(out)


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [p for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [1, 3])
def test_reachable_in_blocks(seed, parts):
    pairs = random_edges(seed, 60, 40 + 15 * seed) + [(100 + i, 101 + i) for i in range(20)]
    src, dst = (np.array(x) for x in zip(*pairs, strict=True))
    got = [(int(x), int(y)) for p in range(parts) for a, b in closure.reachable(src, dst, p, parts, block=8) for x, y in zip(a, b, strict=True)]
    assert sorted(got) == reach(pairs)


@pytest.mark.parametrize("small", [200_000, 30, 0])
def test_closure_by_size_of_component(spark, monkeypatch, small):
    monkeypatch.setattr(algorithms, "CLOSURE_ALONE", 10)
    pairs = [*random_edges(7, 40, 60), *[(200 + i, 201 + i) for i in range(15)], (300, 301), (301, 300)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(map(tuple, algorithms.transitive_closure(df, small=small).collect())) == reach(pairs)


def test_hub_is_closed_without_joins(spark, monkeypatch):
    joins, join = [], algorithms.join_edges
    monkeypatch.setattr(algorithms, "join_edges", lambda *a, **k: joins.append(1) or join(*a, **k))
    pairs = [(i, 1000) for i in range(40)] + [(1000, 2000 + i) for i in range(40)] + [(3000 + i, 3001 + i) for i in range(40)]
    assert sorted(map(tuple, algorithms.transitive_closure(spark.createDataFrame(pairs, "src long, dst long")).collect())) == reach(pairs)
    assert not joins
