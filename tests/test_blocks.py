"""Triangles in tasks: each once, whatever the blocks, and no two-edge path leaves a task."""

import time
from itertools import combinations

import numpy as np
import pytest

from graphloom.operators import blocks
from graphloom.operators.triangles import undirected_triangles
from graphloom.runtime import Workspace

IDS = [-5, 0, 1, 2, 3, 7, 8, 20, 21, 22, 40, 41, 1000, 1001]
#: A hub, near and far neighbours.
EDGES = sorted({p for p in combinations(IDS, 2) if sum(p) % 3 or 7 in p})


def closed(edges):
    linked = set(edges)
    return sorted((a, b, c) for a, b, c in combinations(sorted({x for e in edges for x in e}), 3) if {(a, b), (a, c), (b, c)} <= linked)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [1, 20, 10**6])
def test_each_triangle_once(spark, most):
    pairs = Workspace(spark, "test").cut(spark.createDataFrame(EDGES, "lo long, hi long"))
    assert rows(blocks.triangles(pairs, most, 1)) == closed(EDGES)


def test_ids_too_far_apart_to_be_packed(spark):
    ids = [-(2**63), -(2**62), 5, 6, 2**62, 2**63 - 1]
    edges = [e for e in combinations(ids, 2) if e != (5, 6)]
    pairs = Workspace(spark, "test").cut(spark.createDataFrame(edges, "lo long, hi long"))
    for most in (1, 10**6):
        assert rows(blocks.triangles(pairs, most, 1)) == closed(edges)


def test_small_types_and_no_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "lo int, hi int")
    assert undirected_triangles(pairs).dtypes == [("a", "int"), ("b", "int"), ("c", "int")]
    assert rows(undirected_triangles(pairs)) == [(1, 2, 3)]
    assert rows(undirected_triangles(pairs.where("lo > hi"))) == []


def test_paths_are_not_shuffled(spark):
    # 200 x 200 links and so some 8 million two-edge paths, none of which is closed but by the last edge.
    edges = [(a, b) for a in range(200) for b in range(200, 400)] + [(398, 399)]
    found = undirected_triangles(spark.createDataFrame(edges, "lo long, hi long"))
    assert "Join" not in found._jdf.queryExecution().toString()
    assert rows(found) == [(a, 398, 399) for a in range(200)]


def test_blocks_go_only_where_a_triangle_may_be():
    sizes = np.array([[5, 1, 0], [0, 5, 0], [0, 0, 5]])
    group, tasks = blocks._plan(sizes, 1)
    assert group.tolist() == [0, 1, 2]
    assert sorted(map(tuple, tasks.tolist())) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 2)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
        out = set()
        while found.hasNext():
            out.add(found.next().name())
        return {x for x in out if x.startswith("shuffle_")}

    before = shuffled()
    back = Workspace(spark, "test").cut(spark.range(1000).groupBy("id").count())
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert back.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
