"""python -m graphloom PROGRAM INPUT [options]: whole programs over graph files, through spark-submit or a local session.

triangles, closure, pagerank, components read edge lists; cliques, motifs, frequent read labelled adjacency lists.
The result is written as Parquet with --out, else its first rows and the number of rows are printed.
"""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans import algorithms
from graphloom.runtime import clear_workspaces
from graphloom.sources.text import read_adjacency, read_edge_list


def _levels(levels: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(n)) for n, df in levels.items()])


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The result of one program."""
    if args.program in ("triangles", "closure", "pagerank", "components"):
        g = read_edge_list(spark, args.input, shift=args.shift)
        if args.program == "triangles":
            return algorithms.triangles(g.edges)
        if args.program == "closure":
            return algorithms.transitive_closure(g.edges, distinct_base=not args.bag)
        return algorithms.pagerank(g, args.rounds, args.mode) if args.program == "pagerank" else algorithms.components(g)
    g = read_adjacency(spark, args.input, edge_labels=args.edge_labels, shift=args.shift)
    if args.program == "cliques":
        return _levels(algorithms.k_cliques(g.edges, args.k))
    both = g.symmetrize()
    g = Graph(both.edges if args.edge_labels else both.simplify().edges, g.vertices)
    if args.program == "motifs":
        return algorithms.motif_counts(g, args.k, args.edges, args.dedupe, args.shuffled)
    if args.parity:
        found = algorithms.frequent_subgraphs(g, args.k, args.support, "parity", args.edges, shuffled=args.shuffled)
        return _levels({n: counts for n, (counts, _) in found.items()})
    return _levels(algorithms.frequent_counts(g, args.k, args.support, args.edges))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("program", choices=["triangles", "closure", "pagerank", "components", "cliques", "motifs", "frequent"])
    p.add_argument("input")
    p.add_argument("--out", help="folder for the result as Parquet")
    p.add_argument("--shift", action="store_true", help="ids begin at 0")
    p.add_argument("--bag", action="store_true", help="closure: repeated edges stay repeated")
    p.add_argument("--rounds", type=int, default=4)
    p.add_argument("--mode", choices=["cumulative", "standard"], default="standard")
    p.add_argument("-k", type=int, default=3, help="vertices of the largest subgraph")
    p.add_argument("--edges", type=int, help="edges of the largest subgraph")
    p.add_argument("--support", type=int, default=100)
    p.add_argument("--dedupe", choices=["edge_set", "rule"], default="edge_set")
    p.add_argument("--parity", action="store_true", help="frequent: tuples grow by the ordering rule")
    p.add_argument("--shuffled", action="store_true", help="tuples grow in the shuffled form")
    p.add_argument("--edge-labels", action="store_true", help="each neighbour is followed by the label of its edge")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"graphloom {args.program}").getOrCreate()
    began = time.time()
    df = run(spark, args)
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(20, truncate=False)
        print(df.count(), "rows")
    print(f"{args.program}: {time.time() - began:.1f} s")
    clear_workspaces(spark)


if __name__ == "__main__":
    main()
