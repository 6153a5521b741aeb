"""Cliques as ascending member lists.

``members`` join: k-cliques that share all members but the last are joined pairwise,
and the pair's last members must be linked. The counting form grows each list by a larger
neighbour of any member and keeps a list seen once for each member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def init(pairs: DataFrame) -> DataFrame:
    """2-cliques of ``lo, hi``."""
    return pairs.select(F.array("lo", "hi").alias("members"))


def grow(cliques: DataFrame, pairs: DataFrame, keep: Column | None = None) -> DataFrame:
    """All cliques with one member more, each once. ``keep``: a predicate on the new ``members``."""
    head = F.slice("members", F.lit(1), F.size("members") - 1)
    c = cliques.select(head.alias("head"), F.element_at("members", -1).alias("lo"))
    both = c.join(c.withColumnRenamed("lo", "hi"), "head").where(F.col("lo") < F.col("hi"))
    grown = both.join(pairs, ["lo", "hi"], "left_semi").select(F.concat("head", F.array("lo", "hi")).alias("members"))
    return grown if keep is None else grown.where(keep)


def init_directed(directed: DataFrame) -> DataFrame:
    """2-cliques of ``a, b``, edges that point to the end of larger degree (operators.triangles.oriented)."""
    return directed.select(F.array("a", "b").alias("members"))


def grow_directed(cliques: DataFrame, pairs: DataFrame) -> DataFrame:
    """All cliques with one member more, each once, with members in the order of direction.

    ``pairs``: lo, hi and ``up``, whether the edge points from lo to hi. Members that share all but the
    last are joined pairwise; as every edge points to the end of larger degree, no head has more than about sqrt(2m) of them,
    whatever the hubs.
    """
    head = F.slice("members", F.lit(1), F.size("members") - 1)
    c = cliques.select(head.alias("head"), F.element_at("members", -1).alias("lo"))
    both = c.join(c.withColumnRenamed("lo", "hi"), "head").where(F.col("lo") < F.col("hi")).join(pairs, ["lo", "hi"])
    return both.select(F.concat("head", F.when(F.col("up"), F.array("lo", "hi")).otherwise(F.array("hi", "lo"))).alias("members"))


def grow_any(cliques: DataFrame, pairs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Each list with each larger neighbour of each member, if larger than the last: a bag of candidates. ``keep`` as above."""
    x = cliques.select("members", F.explode("members").alias("lo")).join(pairs, "lo").where(F.col("hi") > F.element_at("members", -1))
    grown = x.select(F.concat("members", F.array("hi")).alias("members"))
    return grown if keep is None else grown.where(keep)


def keep_complete(candidates: DataFrame) -> DataFrame:
    """Candidates that came from every member but the new one, each once."""
    counted = candidates.groupBy("members").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == F.size("members") - 1).select("members")
