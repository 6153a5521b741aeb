"""python tools_skew.py [ROWS]: operators over made-up tables in which one key holds a third of the rows.

Prints for each the seconds, and of the stage with the longest task the longest and the median task. Three executors of two cores.
"""

import json
import shutil
import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import relational, vertex
from graphloom.operators.quantiles import per_key_quantiles
from graphloom.plans import algorithms
from graphloom.runtime import clear_workspaces


def main(rows: int) -> None:
    root = Path(tempfile.mkdtemp(prefix="skew-"))
    (root / "events").mkdir()
    conf = {
        "spark.master": "local-cluster[3,2,3000]", "spark.executor.memory": "1800m", "spark.driver.memory": "1g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{root}/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.checkpoint.dir": f"file://{root}/shared",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    n = rows // 3
    # A third of the edges leave vertex 1, as many enter it; the rest is spread.
    ids = spark.range(rows).withColumn("r", 2 + F.pmod(F.xxhash64("id"), F.lit(n)))
    far = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)) + 2
    edges = ids.select(F.when(F.col("id") < n, F.lit(1)).otherwise(F.col("r")).cast("long").alias("src"), F.when(F.col("id") >= 2 * n, F.lit(1)).otherwise(far).cast("long").alias("dst"))
    edges.write.parquet(f"file://{root}/edges")
    e = spark.read.parquet(f"file://{root}/edges").where("src <> dst")
    g = Graph(e)
    updates = vertex.scatter(e, target=F.col("dst"), origin=F.col("src"))
    few = e.where(F.pmod(F.xxhash64("src", "dst"), F.lit(max(1, rows // 1500))) == 0)

    def join_edges():
        # All edges into the hub meet a share of the edges out of it.
        return relational.join_edges(updates, few, None, lambda u, d: {"a": u("origin"), "b": d("dst")}, relational.hot_targets(updates, few))

    runs = {
        "per_key_quantiles": lambda: per_key_quantiles(e, "src", "dst"), "components": lambda: algorithms.components(g), "components, all rounds distributed": lambda: algorithms.components(g, small=0),
        "join_paths": lambda: algorithms.path_counts(e), "motif3": lambda: algorithms.motif_counts(g, 3), "join_edges": join_edges, "pagerank": lambda: algorithms.pagerank(g, 2),
        "prune_graph": lambda: vertex.prune_graph(Graph(e, vertex.with_degrees(g.ends(), e)), F.col("degree") >= 1).edges,
    }
    took = {}
    for name, f in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        began = time.time()
        f().write.format("noop").mode("overwrite").save()
        took[name] = time.time() - began
        clear_workspaces(spark)
    spark.stop()
    group, tasks = {}, defaultdict(list)
    for line in next((root / "events").iterdir()).open():
        x = json.loads(line)
        if x["Event"] == "SparkListenerJobStart":
            group |= dict.fromkeys(x["Stage IDs"], x["Properties"].get("spark.jobGroup.id"))
        elif x["Event"] == "SparkListenerTaskEnd" and x.get("Task Metrics"):
            tasks[x["Stage ID"]].append(x["Task Metrics"]["Executor Run Time"] / 1000)
    print(f"{rows} edges, a third out of one vertex and a third into it")
    for name, s in took.items():
        worst = max((t for k, t in tasks.items() if group.get(k) == name), key=max)
        print(f"{name}: {s:.1f} s; longest task {max(worst):.1f} s of {len(worst)} in its stage, median {median(worst):.1f} s; all tasks {sum(sum(t) for k, t in tasks.items() if group.get(k) == name):.0f} s")
    shutil.rmtree(root, ignore_errors=True)


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000)
