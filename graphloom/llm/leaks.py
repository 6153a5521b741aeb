"""Evaluation items that occur, whole or in part, in a corpus.

Method: Wu-Manber search for many patterns at once, over words instead of
characters. The patterns are all runs of ``n`` consecutive words of the items, and
the whole of items with fewer words. A window of the shortest pattern's length
moves over a document; the block of its last words gives a shift, which skips
all positions where no pattern can end; where the shift is 0 the block's suffix
bucket gives the patterns that may stand here, and direct comparison confirms.
Patterns are searched in classes of like length, for a short item would make
all shifts short.

The items are a stated set, all documents are read whole. Items are brought to words on the workers and
written. They go to the workers as broadcast blocks of bounded size; a set larger than one block takes one pass
for each block, over documents that were brought to words once for all passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrow import duckdb_session, pieces
from graphloom.llm.visual import LOOK_ALIKES, form_sql, mappings
from graphloom.runtime import Workspace

#: Words of items that one pass over the corpus takes at most; about 100 MB on a worker.
BLOCK_WORDS = 200_000


@lru_cache
def word_key_sql(text: str) -> str:
    """DuckDB SQL: the words of ``text`` in consistent form without letter case, with one space between.

    A capital can look Latin where its small letter does not (the Cyrillic and Greek
    letters for N, T and so on), so with case left out both must meet the Latin letter.
    """
    one = mappings()[0]
    small = {c.lower(): to.lower() for c, to in LOOK_ALIKES.items() if c != c.lower() and c.lower() not in one}
    lower = f"translate(lower({form_sql(text)}), '{''.join(small)}', '{''.join(small.values())}')"
    return f"trim(regexp_replace(replace({lower}, 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


class WuManber:
    """Search for many sequences of words. ``patterns``: sequence of words -> what it stands for."""

    def __init__(self, patterns: dict[tuple[str, ...], tuple]) -> None:
        self.m = m = min(map(len, patterns))
        self.block = b = 2 if m > 1 else 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[tuple[str, ...], tuple]]] = defaultdict(list)
        for words, what in patterns.items():
            for end in range(b, m + 1):
                key = words[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.bucket[words[m - b : m]].append((words, what))

    def find(self, words: list[str]) -> set:
        found: set = set()
        m, b, shift, bucket = self.m, self.block, self.shift, self.bucket
        free = m - b + 1
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift.get(key, free)
            if step:
                end += step
                continue
            start = end - m
            for pattern, what in bucket[key]:
                if words[start] == pattern[0] and tuple(words[start : start + len(pattern)]) == pattern:
                    found.update(what)
            end += 1
        return found


def build(items: Sequence[tuple[object, str]], n: int) -> list[WuManber]:
    """Searchers for all patterns of (item, words with one space between), one for each class of lengths."""
    full: dict[tuple[str, ...], set] = defaultdict(set)
    short: dict[tuple[str, ...], set] = defaultdict(set)
    for item, key in items:
        words = key.split(" ") if key else []
        if 0 < len(words) < n:
            short[tuple(words)].add(item)
        for i in range(len(words) - n + 1):
            full[tuple(words[i : i + n])].add(item)
    classes: dict[int, dict] = defaultdict(dict)
    for words, what in short.items():
        classes[min(len(words), 4)][words] = tuple(what)
    if full:
        classes[n] = {**classes.get(n, {}), **{k: tuple(v) for k, v in full.items()}}
    return [WuManber(c) for c in classes.values()]


def _keys():
    """Gives (id, words with one space between) of (id, text)."""
    # The SQL is made here, on the driver: its tables take a second or two.
    sql = f"SELECT id, {word_key_sql('text')} AS k FROM part"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        con = duckdb_session()
        for batch in batches:
            for part in pieces(batch, 1):
                con.register("part", pa.Table.from_batches([part]))
                yield from con.sql(sql).to_arrow_table().to_batches()

    return run


def _search(block, n: int, item_type: str, ready: bool):
    """Searches (id, text) or, if ``ready``, (id, words) for the items of a broadcast block."""
    keys = None if ready else _keys()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # The broadcast variable lives as long as the worker, so the tables are built once for all its tasks.
        if not hasattr(block, "_searchers"):
            block._searchers = build(block.value, n)
        searchers = block._searchers
        for part in (p for batch in batches for p in pieces(batch, 1)) if keys is None else keys(batches):
            docs, hits = [], []
            for doc, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = key.split(" ")
                found: set = set()
                for s in searchers:
                    found |= s.find(words)
                docs.extend([doc] * len(found))
                hits.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, part.schema.field(0).type), pa.array(hits, pa.int64() if item_type == "bigint" else pa.string())], names=["id", "item"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id, item``: each document with each item of which it holds ``n`` consecutive words, or all words of a shorter item.

    Words are the longest runs of letters and digits of the consistent form, without
    letter case. Null, empty and wordless texts and items match nothing; items with
    the same words all match; ids may repeat (the result has one row for each document row and
    item); other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = "bigint" if items.schema[item_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    wanted = items.select(F.col(item_id).cast(item_kind).alias("id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    source = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    work = Workspace(spark, "leaks")
    keys = work.cut(wanted.mapInArrow(_keys(), f"id {item_kind}, k string").where(F.col("k") != "").select("id", "k", (F.length("k") - F.length(F.replace("k", F.lit(" "), F.lit(""))) + 1).alias("n")))
    total = keys.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], f"id {kind}, item {item_kind}")
    ready = total > block_words
    if ready:
        # More than one block: the corpus is brought to words once, and each block reads those.
        source = work.cut(source.mapInArrow(_keys(), f"id {kind}, k string").where(F.col("k") != ""))
    out, block, held = None, [], 0

    def searched() -> DataFrame:
        sent = spark.sparkContext.broadcast(block)
        part = source.mapInArrow(_search(sent, n, item_kind, ready), f"id {kind}, item {item_kind}")
        return part if out is None else out.unionByName(part)

    # The driver holds one block of items at a time.
    for item, key, size in keys.toLocalIterator():
        if block and held + size > block_words:
            out, block, held = searched(), [], 0
        block.append((item, key))
        held += size
    return searched()
