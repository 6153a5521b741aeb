"""How often every distinct term occurs, in how many records, and whether it is too rare or too common.

Method: each record gives its terms with their counts inside the record; Spark
combines them by hash within each map task before the shuffle (partial
aggregation), so a frequent term costs one row per task; occurrences and records
are then summed and the frequency bounds applied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_counts(df: DataFrame, terms: Column) -> DataFrame:
    """``term, occ`` of every record: its distinct non-null terms, each with its count in the record.

    The record's terms are sorted and the lengths of equal runs taken, so a long
    record costs n log n and no shuffle. The steps are projections of their own, for
    an expression inside a lambda is worked out anew for every element.
    """
    sorted_ = df.select(F.sort_array(F.filter(terms, lambda x: x.isNotNull())).alias("_s"))
    last = F.greatest(F.size("_s") - 1, F.lit(0))
    begins = lambda i: F.get("_s", i).isNotNull() & ((i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = sorted_.select("_s", F.filter(F.sequence(F.lit(0), last), begins).alias("_at"))
    ends = runs.select("_s", "_at", F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_s"))).alias("_end"))
    # A record without terms has no beginning; its one end is cut off with it.
    pairs = F.zip_with("_at", F.slice("_end", F.lit(1), F.size("_at")), lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("long").alias("occ")))
    return ends.select(F.explode(pairs).alias("_t")).select("_t.term", "_t.occ")


def term_counts(df: DataFrame, columns: Sequence[str], rare_below: int = 5, common_above: float = 0.03) -> DataFrame:
    """``term, occurrences, records, mark`` of every distinct value of ``columns``.

    ``columns`` are scalar columns of one type, or one array column whose elements
    are the terms. A record counts once for a term however often it holds it. ``mark`` is ``rare`` (in fewer
    than ``rare_below`` records), ``common`` (in more than ``common_above`` of all
    rows of ``df``, rows without a term included) or null; a term that is both, as in
    a tiny table, is ``rare``. Nulls are no terms. Repeated rows count. An empty
    table gives an empty result; other columns are ignored.
    """
    array = len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.ArrayType)
    records = record_counts(df, F.col(columns[0]) if array else F.array(*[F.col(c) for c in columns]))
    counts = records.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.count("*").alias("records"))
    total = df.count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.lit(total), "common")
    return counts.withColumn("mark", mark)
