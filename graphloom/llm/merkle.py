"""Records that differ only in dress: Merkle-style digests of nested records, and their groups.

Method: bottom-up hashing. Leaves are normalised and hashed; the digest of a node
is the hash of its children's digests, which are sorted first where the order of
children carries no meaning (struct fields, maps, arrays unless told otherwise). Records are
grouped by the root digest, and a group is confirmed by full comparison of the
normalised structures.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.runtime import HOT_ROWS, Workspace, hot_keys, lookup


def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(text: Column) -> Column:
    """``text`` with accents composed. Only texts with a combining mark, here rare, are sent to Python."""
    udf = F.pandas_udf(_nfc, T.StringType())
    return F.coalesce(udf(F.when(text.rlike(r"\p{M}"), text)), text)


def normal_leaf(text: Column) -> Column:
    """Letters and digits only, in lower case; accents and leading zeros stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _hash(tag: str, body: Column) -> Column:
    """Hex digest of a node; the tag keeps nodes of different kinds apart."""
    return F.md5(F.concat(F.lit(tag), body).cast("binary"))


def normalised(column: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """The value with every text leaf in normal form and every other leaf as text (binary stays), and its type."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, *normalised(column.getField(f.name), f.dataType)) for f in kind.fields]
        new = T.StructType([T.StructField(n, k) for n, _, k in parts])
        value = F.struct(*[c.alias(n) for n, c, _ in parts]) if parts else column
        return F.when(column.isNotNull(), value), new
    if isinstance(kind, T.ArrayType):
        inner = normalised(F.lit(None).cast(kind.elementType), kind.elementType)[1]
        return F.transform(column, lambda x: normalised(x, kind.elementType)[0]), T.ArrayType(inner)
    if isinstance(kind, T.MapType):
        # Keys may become equal, which a map doesn't allow: entries in sorted order.
        k, v = (normalised(F.lit(None).cast(t), t)[1] for t in (kind.keyType, kind.valueType))
        entry = T.StructType([T.StructField("key", k), T.StructField("value", v)])
        pairs = F.transform(F.map_entries(column), lambda e: F.struct(normalised(e["key"], kind.keyType)[0].alias("key"), normalised(e["value"], kind.valueType)[0].alias("value")))
        return F.array_sort(pairs), T.ArrayType(entry)
    if isinstance(kind, T.BinaryType):
        return column, kind
    # Only text is written in many ways; the sign and the point of a number count.
    text = column.cast("string")
    return (normal_leaf(text) if isinstance(kind, T.StringType) else text), T.StringType()


def digest(column: Column, kind: T.DataType, ordered_arrays: bool = False) -> Column:
    """The Merkle digest (32 hex digits) of a normalised value. Null has a digest of its own at every level.

    Struct fields, map entries and, unless ``ordered_arrays``, array elements count
    without their order; how often an element occurs counts.
    """
    if isinstance(kind, T.StructType):
        kids = [_hash(f"field {f.name.lower()}=", digest(column.getField(f.name), f.dataType, ordered_arrays)) for f in kind.fields]
        body, tag = F.concat_ws("", F.sort_array(F.array(*kids))) if kids else F.lit(""), "struct:"
    elif isinstance(kind, T.ArrayType):
        kids = F.transform(column, lambda x: digest(x, kind.elementType, ordered_arrays))
        body, tag = F.concat_ws("", kids if ordered_arrays else F.sort_array(kids)), "list:" if ordered_arrays else "bag:"
    elif isinstance(kind, T.BinaryType):
        body, tag = F.hex(column), "bytes:"
    else:
        body, tag = column, "text:"
    return F.when(column.isNull(), F.md5(F.lit("null").cast("binary"))).otherwise(_hash(tag, body))


def edges_of_records(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``rec_id, edge``: struct(src, target) of each free-form record with both keys, else null.

    The record is taken apart at its keys, which stand as words of their own, the
    first of them as the first word. The scan is linear in the length of the text; the words are
    a projection of their own, or they would be worked out anew for each use.
    """
    texts = df.select(F.col(id_col).alias("rec_id"), composed(F.col(body_col)).alias("_b"))
    lists = texts.select("rec_id", F.trim(F.regexp_replace(F.lower("_b"), r"[^\p{L}\p{N}]+", " ")).alias("_w"))
    return lists.select("rec_id", _edge_of_words(F.col("_w")).alias("edge"))


def _edge_of_words(words: Column) -> Column:

    def parts(first: str, second: str) -> tuple[Column, Column]:
        rest = F.substring(words, F.lit(len(first) + 2), F.length(words))
        cut = F.locate(f" {second} ", rest)
        return cut, rest

    cut_s, rest_s = parts("src", "target")
    cut_t, rest_t = parts("target", "src")
    before = lambda rest, cut: F.substring(rest, F.lit(1), cut - 1)
    after = lambda rest, cut, key: F.substring(rest, cut + len(key) + 2, F.length(rest))
    src_first = F.struct(before(rest_s, cut_s).alias("src"), after(rest_s, cut_s, "target").alias("target"))
    target_first = F.struct(after(rest_t, cut_t, "src").alias("src"), before(rest_t, cut_t).alias("target"))
    return F.when(words.startswith("src ") & (cut_s > 1), src_first).when(words.startswith("target ") & (cut_t > 1), target_first)


def collapse_copies(df: DataFrame, id_col: str, record: Column, kind: T.DataType, hot_rows: int = HOT_ROWS, ordered_arrays: bool = False) -> DataFrame:
    """Every record with its group: ``rec_id``, ``first_id`` (the least id of the group) and ``copies`` (its size).

    ``record`` is the nested value to compare, of type ``kind``; with ``ordered_arrays`` the order of array elements counts. Null records are in
    no group and are left out; rows with a null id too. Groups of any size are
    counted by partial aggregation, and members of a hot group meet their first
    record by broadcast, so a group with a third of all rows makes no long task.
    """
    work = Workspace(df.sparkSession, "merkle")
    value, plain = normalised(F.col("_r"), kind)
    rows = df.select(F.col(id_col).alias("rec_id"), record.alias("_r")).where(F.col("rec_id").isNotNull()).select("rec_id", value.alias("_n"))
    rows = rows.select("rec_id", F.when(F.col("_n").isNotNull(), F.unhex(digest(F.col("_n"), plain, ordered_arrays))).alias("_d"), canonical(F.col("_n"), plain, ordered_arrays).alias("_full"))
    # Null records go only after the cut: as a filter before it, the whole parsing would be pushed down and done twice.
    rows = work.cut(rows).where(F.col("_d").isNotNull())
    # Grouped by root digest; that the whole structure is part of the key is the confirmation.
    found = rows.groupBy("_d", "_full").agg(F.min("rec_id").alias("first_id"), F.count("*").alias("copies"))
    groups = work.cut(found.withColumn("_alone", F.col("copies") == 1))
    # Digests of several structures: expected none, but their records are then told apart by the structure.
    shared = groups.groupBy("_d").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("_d")
    shared = work.cut(shared)
    alone = groups.where("_alone").select(F.col("first_id").alias("rec_id"), "first_id", "copies")
    several = groups.where(~F.col("_alone"))
    total = several.agg(F.sum("copies")).first()[0] or 0
    if shared.isEmpty():
        hot = hot_keys(rows, "_d", total, several.select("_d", F.col("copies").alias("n")), hot_rows)
        members = lookup(rows.select("rec_id", "_d"), several.select("_d", "first_id", "copies"), "_d", hot)
    else:
        members = rows.join(several.drop("_alone"), ["_d", "_full"])
    return members.select("rec_id", "first_id", "copies").unionByName(alone)


def canonical(column: Column, kind: T.DataType, ordered_arrays: bool = False) -> Column:
    """Canonical text of a normalised value: unordered nodes in sorted order, lengths before contents."""

    def sized(c: Column) -> Column:
        return F.concat(F.length(c).cast("string"), F.lit(":"), c)

    if isinstance(kind, T.StructType):
        kids = F.sort_array(F.array(*[F.concat(F.lit(f.name.lower() + "="), canonical(column.getField(f.name), f.dataType, ordered_arrays)) for f in kind.fields]))
        body, tag = F.concat_ws(",", F.transform(kids, sized)), "s"
    elif isinstance(kind, T.ArrayType):
        kids = F.transform(column, lambda x: canonical(x, kind.elementType, ordered_arrays))
        kids = kids if ordered_arrays else F.sort_array(kids)
        body, tag = F.concat_ws(",", F.transform(kids, sized)), "a"
    elif isinstance(kind, T.BinaryType):
        body, tag = F.hex(column), "b"
    else:
        body, tag = column, "l"
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit(tag + "("), body, F.lit(")")))
