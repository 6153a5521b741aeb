"""Session helpers: where lineage is cut, and how hot keys are joined.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir``
names. That folder is shared by all executors, so a table written there outlives
the executor that wrote it. Only where the setting is absent (local tests) is a
temporary folder of this machine used.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is hot, in a table of any size: one task reads so many rows in a second or so.
HOT_ROWS = 200_000
#: A join's part for one task has at most the square of this many rows (see hot_pairs).
TILE = 4096
#: So many hot keys at most are broadcast as they are; more of them are marked by hash bucket.
FEW_HOT = 10_000
BUCKETS = 65_536
#: A join with hot keys has so many tasks at most for its parts.
MOST_TASKS = 10_000

#: Whether the shuffle files of a finished write are deleted.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None
_workspaces: list[str] = []
_files: list = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _local_root


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Workspace:
    """Intermediate tables of one run of an operator, in the shared folder.

    ``cut`` writes a DataFrame and returns the DataFrame that reads it back;
    ``drop`` deletes a table that nothing refers to any more. Tables that the
    result still reads stay until ``clear_workspaces`` or the end of the process; what a
    process that died left behind is deleted by ``sweep``.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        if not _files:
            # Kept for the end of the process, when the session may be stopped already.
            _files.extend([spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()])
            atexit.register(_clear_at_exit)
        self.root = f"{shared_root(spark)}/graphloom-{label}-{uuid.uuid4().hex[:12]}"
        _workspaces.append(self.root)
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def cut(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        # What was shuffled for a table isn't needed once it stands, and would take disk until the driver collects garbage.
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        return back

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            kept = self._paths.pop(id(df), None)
            if kept:
                _delete(self.spark, kept[1])


    def tables(self) -> list[str]:
        """The tables that are there."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit() -> None:
    jvm, conf = _files
    for root in _workspaces:
        try:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may be gone; sweep() remains
            return


def sweep(spark: SparkSession, older_than_hours: float = 48.0) -> int:
    """Delete workspaces of any process in the shared folder that nothing was written to for so long; returns their number."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n, before = 0, (time.time() - older_than_hours * 3600) * 1000
    for found in fs.listStatus(root) if fs.exists(root) else []:
        inner = [x.getModificationTime() for x in fs.listStatus(found.getPath())] if found.isDirectory() else []
        if found.getPath().getName().startswith("graphloom-") and max([found.getModificationTime(), *inner]) < before:
            n += bool(fs.delete(found.getPath(), True))
    return n


def clear_workspaces(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; results that aren't written yet can't be read any more."""
    while _workspaces:
        _delete(spark, _workspaces.pop())


@dataclass(frozen=True)
class Hot:
    """Keys with too many rows for one task, with the number of parts for each side of a join.

    ``table`` has the key columns (or ``_bucket``, a hash of them), ``_pl`` and ``_pr``, and at most
    FEW_HOT (or BUCKETS) rows whatever the data, so it is always safe to broadcast.
    """

    table: DataFrame
    by_bucket: bool
    keys: tuple[str, ...]
    tiles: int

    def on(self, keys: Sequence[str]) -> Hot:
        """The same keys under other column names."""
        if tuple(keys) == self.keys:
            return self
        table = self.table if self.by_bucket else self.table.withColumnsRenamed(dict(zip(self.keys, keys, strict=True)))
        return Hot(table, self.by_bucket, tuple(keys), self.tiles)

    def mark(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_pl`` and ``_pr``, 1 for keys that aren't hot."""
        on = list(self.keys)
        if self.by_bucket:
            df, on = df.withColumn("_bucket", _bucket(self.keys)), ["_bucket"]
        both = df.join(F.broadcast(self.table), on, "left")
        both = both.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_pl", "_pr")})
        return both.drop("_bucket") if self.by_bucket else both


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _names(key: str | Sequence[str]) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else tuple(key)


def _hot_table(parts: DataFrame, keys: tuple[str, ...]) -> Hot | None:
    """``parts``: keys, _pl, _pr of hot keys only. Beyond FEW_HOT keys a hash bucket has the parts of its largest key."""
    spark, wanted = parts.sparkSession, parts.select(*keys, F.col("_pl").cast("int"), F.col("_pr").cast("int"))
    rows = wanted.take(FEW_HOT + 1)
    if not rows:
        return None
    if len(rows) <= FEW_HOT:
        return Hot(spark.createDataFrame(rows, wanted.schema), False, keys, sum(r["_pl"] * r["_pr"] for r in rows))
    buckets = wanted.groupBy(_bucket(keys).alias("_bucket")).agg(F.max("_pl").alias("_pl"), F.max("_pr").alias("_pr"))
    rows = buckets.collect()
    return Hot(spark.createDataFrame(rows, buckets.schema), True, keys, sum(r["_pl"] * r["_pr"] for r in rows))


def hot_keys(df: DataFrame | None, key: str | Sequence[str], total: int | None = None, counts: DataFrame | None = None, limit: int = HOT_ROWS) -> Hot | None:
    """The keys of ``df`` with more than ``limit`` rows, or None.

    The limit is what one task may well read; it doesn't grow with the table.
    ``counts`` (key, n) saves the aggregation where the caller has it already; a ``total``
    of rows up to ``limit`` tells without a job that there are none.
    """
    if total is not None and total <= limit:
        return None
    keys = _names(key)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return _hot_table(counts.where((F.col("n") > limit) & known).select(*keys, F.ceil(F.col("n") / limit).alias("_pl"), F.lit(1).alias("_pr")), keys)


def hot_by_bucket(df: DataFrame, key: str, limit: int = HOT_ROWS) -> Hot | None:
    """``hot_keys`` of a written table with many keys: rows are counted by hash bucket first, and by key only in buckets with more than ``limit``."""
    full = df.groupBy(_bucket([key]).alias("_bucket")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("_bucket")
    rows = full.collect()
    if not rows:
        return None
    marks = F.broadcast(df.sparkSession.createDataFrame(rows, full.schema))
    return hot_keys(df.withColumn("_bucket", _bucket([key])).join(marks, "_bucket", "left_semi"), key, limit=limit)


def hot_pairs(left: DataFrame, right: DataFrame, key: str | Sequence[str], limit: int = HOT_ROWS, tile: int = TILE) -> Hot | None:
    """Hot keys of a join in which both sides repeat keys, or None.

    A key is hot if a side has more than ``limit`` rows of it, or the join more than ``tile`` * ``tile``. Its rows
    of the left are cut into ``_pl`` parts and those of the right into ``_pr``, so that no part has more than that.
    """
    keys = _names(key)
    if right is left:
        # A table joined with itself needs one count, and no join.
        n = left.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > min(limit, tile)) & reduce(and_, [F.col(k).isNotNull() for k in keys]))
        parts_of_one = F.ceil(F.col("n") / F.least(F.lit(float(limit)), F.lit(float(tile))))
        return _hot_table(n.select(*keys, parts_of_one.alias("_pl"), parts_of_one.alias("_pr")), keys)
    nl, nr = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "nl"), (right, "nr")))
    both = nl.join(nr, list(keys)).where((F.col("nl") > limit) | (F.col("nr") > limit) | (F.col("nl") * F.col("nr").cast("double") > tile * tile))

    def parts(own: str, other: str) -> Column:
        return F.ceil(F.col(own) / F.least(F.lit(float(limit)), F.lit(float(tile * tile)) / F.least(other, F.lit(tile))))

    return _hot_table(both.select(*keys, parts("nl", "nr").alias("_pl"), parts("nr", "nl").alias("_pr")), keys)


def lookup(left: DataFrame, table: DataFrame, key: str | Sequence[str], hot: Hot | None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``table``, in which each key occurs once, whatever the skew of ``left``.

    Rows of hot keys stay where they are and meet the table's few rows for them by
    broadcast (at most FEW_HOT rows); all other rows are joined by shuffle. With more hot keys than
    that, rows are salted instead. ``how`` is ``inner`` or ``left``.
    """
    keys = list(_names(key))
    if hot is None:
        return left.join(table, keys, how)
    hot = hot.on(keys)
    if hot.by_bucket:
        columns = [*left.columns, *[c for c in table.columns if c not in keys]]
        return _salted(left, table, keys, hot, None, None, how).select(*columns)
    marks = F.broadcast(hot.table.select(*keys))
    few = F.broadcast(table.join(marks, keys, "left_semi"))
    at_home = left.join(few, keys) if how == "inner" else left.join(marks, keys, "left_semi").join(few, keys, "left")
    return at_home.unionByName(left.join(marks, keys, "left_anti").join(table, keys, how))


def salted_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], hot: Hot | None, spread: str | None = None, spread_right: str | None = None) -> DataFrame:
    """Inner join of sides that both may repeat keys (see ``hot_pairs`` and ``hot_keys``).

    A hot key's rows of a side are cut into parts by the hash of column ``spread`` (of all columns unless
    given) and met by a copy of each part of the other side. Rows equal in what they are cut by stay together.
    """
    keys = list(_names(key))
    return left.join(right, keys) if hot is None else _salted(left, right, keys, hot.on(keys), spread, spread_right, "inner")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], hot: Hot, spread: str | None, spread_right: str | None, how: str) -> DataFrame:
    def cut(df: DataFrame, own: str, other: str, mine: str, theirs: str, by: str | None) -> DataFrame:
        part = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*([by] if by else df.columns)), F.col(own)).cast("int")).otherwise(0)
        copies = F.when(F.col(other) > 1, F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))
        return hot.mark(df).withColumn(mine, part).withColumn(theirs, F.explode(copies)).drop("_pl", "_pr")

    on = [*keys, "_sl", "_sr"]
    # A given number of partitions, or adaptive execution would put parts together again that are small until they are joined.
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(hot.tiles, MOST_TASKS))
    l, r = cut(left, "_pl", "_pr", "_sl", "_sr", spread), cut(right, "_pr", "_pl", "_sr", "_sl", spread_right)  # noqa: E741
    return l.repartition(parts, *on).join(r.repartition(parts, *on), on, how).drop("_sl", "_sr")
