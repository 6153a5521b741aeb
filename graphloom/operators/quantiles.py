"""Per-key counts and exact quantiles that no hot key can slow down.

Method: distributed exact selection. Each round counts values by key and by the
next binary digits of the value, beginning at the highest bit in which values of
the table differ. Such histograms merge by addition, so every map task sends at most
one count per key and bin, however many rows a key has. The bin that holds the
wanted rank is kept and refined by the next digit until the rank resolves: a bin
with one distinct value, or a rank at a bin's lower or upper end, is resolved at
once. No round gathers the values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.runtime import HOT_ROWS, Workspace, hot_keys, lookup


def _as_long(df: DataFrame, name: str) -> Column:
    """The value as a long of the same order."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # The bits of a double, turned so that they sort as signed numbers; adding 0 makes -0.0 equal 0.0, NaN is the greatest.
        value = F.col(name).cast("double") + F.lit(0.0)
        bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0))).cast("long")
        return F.when(value.isNotNull(), _turned(bits))
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long")
    raise ValueError(f"{name}: quantiles need a number, date or timestamp column, not {kind.simpleString()}")


def _turned(bits: Column) -> Column:
    """Bits of a double to a long of the same order, and back."""
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _as_double(value: Column) -> Column:
    text = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _turned(F.coalesce(value, F.lit(0).cast("long"))))
    return F.when(value.isNotNull(), text.cast("double"))


def _pick(hist: DataFrame, within: list[str], wanted: DataFrame | None, probs: Sequence[float]) -> DataFrame:
    """Rows of ``hist`` that hold a wanted rank, with ``prob`` and the rank inside the bin.

    A window here holds the bins of one key under one prefix: at most 2 ** bits rows.
    """
    per = Window.partitionBy(*within)
    h = hist.withColumn("_below", F.sum("_c").over(per.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    if wanted is None:
        h = h.withColumn("_all", F.sum("_c").over(per)).withColumn("_prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        h = h.withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_prob") * F.col("_all")).cast("long")))
    else:
        h = h.join(wanted, within)
    h = h.where((F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("_below") + F.col("_c")))
    return h.withColumn("_rank", F.col("_rank") - F.col("_below")).drop("_below", "_all")


def per_key_quantiles(
    df: DataFrame, key: str, value: str, probs: Sequence[float] = (0.25, 0.5, 0.75), hot_share: float = 0.02, bits: int = 10, limit: int = HOT_ROWS
) -> DataFrame:
    """One row for each non-null ``key``: ``n_rows``, ``n_values``, ``hot`` and ``q0`` .. one per probability.

    ``q_i`` is the smallest value with at least ``probs[i]`` of the key's non-null
    values at or below it (the least value for 0), as a long (microseconds for
    timestamps, days for dates) or, for floats, a double, with NaN as the greatest and no negative zero. ``hot`` marks keys with more than ``hot_share`` of
    all rows whose key is not null.

    Null keys are left out; null values count in ``n_rows`` only, and a key with
    nothing else has null quantiles. Repeated rows count as often as they occur.
    An empty table gives an empty result. Other columns are ignored.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie between 0 and 1")
    work = Workspace(df.sparkSession, "quantiles")
    rows = df.select(F.col(key).alias("_k"), _as_long(df, value).alias("_v")).where(F.col("_k").isNotNull())
    low, high, total = rows.agg(F.min("_v"), F.max("_v"), F.count("*")).first()
    low, high = (low, high) if low is not None else (0, 0)
    width = (high - low).bit_length()
    # As few rounds as bins of at most 2 ** bits allow, with digits of like length.
    bits = -(-width // -(-width // bits)) if width else bits
    counts = [F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    shift = max(0, width - bits)
    hist = work.cut(rows.groupBy("_k", F.shiftright("_v", shift).alias("_bin")).agg(*counts))
    totals = hist.groupBy("_k").agg(F.sum("_c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_c"))), F.lit(0)).alias("n_values"))
    picked = work.cut(_pick(hist.where(F.col("_bin").isNotNull()), ["_k"], None, probs).withColumnRenamed("_bin", "_prefix"))
    done = []
    while True:
        ended = (F.col("_lo") == F.col("_hi")) | (F.col("_rank") == 1) | (F.col("_rank") == F.col("_c"))
        done.append(picked.where(ended).select("_k", "_prob", F.when(F.col("_rank") == 1, F.col("_lo")).otherwise(F.col("_hi")).alias("_q")))
        open_ = picked.where(~ended)
        if shift == 0 or open_.isEmpty():
            break
        # Rows in a bin that is still open go on; those of bins with more rows than a task should read aren't shuffled for it.
        bins = open_.groupBy("_k", "_prefix").agg(F.max("_c").alias("n"))
        here = rows.where(F.col("_v").isNotNull()).withColumn("_prefix", F.shiftright("_v", shift))
        kept = lookup(here, bins.select("_k", "_prefix"), ["_k", "_prefix"], hot_keys(None, ["_k", "_prefix"], total, bins, limit))
        rows = work.cut(kept.select("_k", "_v", "_prefix")) if shift > bits else kept
        shift_next = max(0, shift - bits)
        finer = rows.groupBy("_k", "_prefix", F.shiftright("_v", shift_next).alias("_bin")).agg(*counts)
        wanted = open_.select("_k", "_prefix", "_prob", "_rank")
        picked = work.cut(_pick(finer, ["_k", "_prefix"], wanted, probs).drop("_prefix").withColumnRenamed("_bin", "_prefix"))
        rows, shift = rows.select("_k", "_v"), shift_next
    resolved = done[0]
    for d in done[1:]:
        resolved = resolved.unionByName(d)
    wide = resolved.groupBy("_k").agg(*[F.max(F.when(F.col("_prob") == float(p), F.col("_q"))).alias(f"q{i}") for i, p in enumerate(probs)])
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        wide = wide.select("_k", *[_as_double(F.col(f"q{i}")).alias(f"q{i}") for i in range(len(probs))])
    out = totals.join(wide, "_k", "left").withColumn("hot", F.col("n_rows") > F.lit(hot_share) * F.lit(total))
    return out.select(F.col("_k").alias(key), "n_rows", "n_values", "hot", *[f"q{i}" for i in range(len(probs))])
