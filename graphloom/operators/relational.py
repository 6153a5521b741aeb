"""Relational algebra over updates keyed by ``target``.

Predicates say which rows to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import HOT_ROWS, TILE, Hot, hot_pairs, salted_join

Pick = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def join_edges(updates: DataFrame, edges: DataFrame, keep: Pick | None, project: Callable[..., dict[str, Column]], hot: Hot | None = None) -> DataFrame:
    """Equi-join ``updates.target = edges.src`` (bags), then ``keep``, then ``project``.

    Both get two functions, of a name to a column: of the update, and of the edge.
    ``hot``: keys with too many rows or too many results for one task (``hot_targets``), whose
    rows are cut into parts on both sides.
    """
    u = updates.withColumnsRenamed({c: f"u_{c}" for c in updates.columns}).withColumn("_key", F.col("u_target"))
    e = edges.withColumnsRenamed({c: f"e_{c}" for c in edges.columns}).withColumn("_key", F.col("e_src"))
    of_u = lambda n: F.col(f"u_{n}")
    of_e = lambda n: F.col(f"e_{n}")
    both = salted_join(u, e, "_key", hot)
    both = both if keep is None else both.where(keep(of_u, of_e))
    return both.select(*[c.alias(n) for n, c in project(of_u, of_e).items()])


def hot_targets(updates: DataFrame, edges: DataFrame, limit: int = HOT_ROWS, tile: int = TILE) -> Hot | None:
    """What ``join_edges`` needs to know of hot keys: one count of either side by key."""
    return hot_pairs(updates.select(F.col("target").alias("_key")), edges.select(F.col("src").alias("_key")), "_key", limit, tile)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that equal no row of ``right``, repeated as often as in ``left``; nulls equal nulls."""
    on = None
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    for c in left.columns:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = same if on is None else on & same
    return l.join(r, on, "left_anti")


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two bags."""
    return left.unionByName(right)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.distinct()


def row_count(df: DataFrame) -> DataFrame:
    """``n_rows`` of ``df``."""
    return df.agg(F.count("*").alias("n_rows"))


def has_ended(df: DataFrame) -> bool:
    """Whether ``df`` is empty, the test that ends a fixpoint loop."""
    return df.isEmpty()
