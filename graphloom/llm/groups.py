"""One group identifier for all vertices that pairs link directly or through others.

Method: deterministic Borůvka hooking (see ``operators.components``): every component selects its
smallest outgoing edge, trees collapse by pointer doubling, edges are relabelled and
deduplicated until none remain. The last root is the least vertex of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import SMALL, component_map
from graphloom.runtime import HOT_ROWS


def link_groups(pairs: DataFrame, src: str = "src", target: str = "target", hot_rows: int = HOT_ROWS, small: int = SMALL) -> DataFrame:
    """``group_id, vertex_id``: one row for each vertex of a pair with both ends present.

    ``group_id`` is the least vertex linked with the vertex, directly or indirectly.
    A vertex paired only with itself is a group of one. Pairs with a null end are
    left out; direction and repetition don't matter; an empty table gives an empty
    result; other columns are ignored. The first round is always distributed, and so is every other of a graph of more
    than ``small`` rows.
    """
    both = pairs.select(F.col(src).alias("a"), F.col(target).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    lone = both.where(F.col("a") == F.col("b")).select(F.col("a").alias("vertex_id")).distinct()
    ends = both.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    linked = component_map(ends, hot_rows, small).select(F.col("p").alias("group_id"), F.col("c").alias("vertex_id"))
    alone = lone.join(linked.select("vertex_id"), "vertex_id", "left_anti")
    return linked.unionByName(alone.select(F.col("vertex_id").alias("group_id"), "vertex_id"))
