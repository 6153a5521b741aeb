"""The registered queries of this package, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import plain_forms
from graphloom.llm.encode import encode_corpus
from graphloom.llm.groups import link_groups
from graphloom.llm.leaks import leaked_items
from graphloom.llm.merkle import collapse_copies, edges_of_records
from graphloom.llm.terms import term_counts
from graphloom.llm.visual import consistent_form, look_alike_classes, look_alike_pairs

EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("target", T.StringType())])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_copies(edges_of_records(_table(spark, sf, "edge_records"), "rec_id", "body"), "rec_id", F.col("edge"), EDGE)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf).where(F.col("rec_id") > F.col("first_id")).select("first_id", "rec_id")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per edge with the number of its copies."""
    return _copies(spark, sf).where(F.col("rec_id") == F.col("first_id")).select("first_id", "copies")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts(_table(spark, sf, "labeled_edges"), ["src_label", "target_label"], rare_below=5, common_above=0.03)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).where(F.col("mark").isNotNull()).select(F.col("term").cast("long").alias("label"), "mark")


def p4_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every label with its occurrences and rows."""
    return _labels(spark, sf).select(F.col("term").cast("long").alias("label"), "occurrences", F.col("records").alias("n_rows"), "mark")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return link_groups(_table(spark, sf, "match_pairs"))


def p5_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every round distributed, and so low a limit that vertices are hot at any size."""
    return link_groups(_table(spark, sf, "match_pairs"), hot_rows=100, small=0)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = look_alike_pairs(_table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text in the consistent form."""
    return consistent_form(_table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that looks like one with another text, with its class."""
    return look_alike_classes(_table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_records, p4_found, p4_labels, p5_found, p5_rounds, p6_ids, p7_found, p8_found, p8_forms, p8_classes)
}

#: The edge of a record as an expression over its words; the table's records have no accents set apart.
_RECORDS = """
WITH folded AS (SELECT rec_id, regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', '', 'g') AS f FROM edge_records WHERE body IS NOT NULL),
named AS (
  SELECT rec_id,
    CASE WHEN f LIKE 'src%' THEN regexp_extract(f, '^src(.+?)target(.+)$', 1) ELSE regexp_extract(f, '^target(.+?)src(.+)$', 2) END AS s,
    CASE WHEN f LIKE 'src%' THEN regexp_extract(f, '^src(.+?)target(.+)$', 2) ELSE regexp_extract(f, '^target(.+?)src(.+)$', 1) END AS t
  FROM folded WHERE regexp_matches(f, '^src.+target.+$') OR regexp_matches(f, '^target.+src.+$')),
grouped AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY s, t) AS first_id, count(*) OVER (PARTITION BY s, t) AS copies FROM named)
"""
_LABELS = """
WITH ends AS (SELECT row_id, unnest([src_label, target_label]) AS label FROM labeled_edges),
counted AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS occurrences, count(DISTINCT row_id) AS n_rows FROM ends WHERE label IS NOT NULL GROUP BY 1),
marked AS (SELECT *, CASE WHEN n_rows < 5 THEN 'rare' WHEN n_rows > 0.03 * (SELECT count(*) FROM labeled_edges) THEN 'common' END AS mark FROM counted)
"""

_GROUPS = """
WITH RECURSIVE links AS (
  SELECT src AS a, target AS b FROM match_pairs WHERE src IS NOT NULL AND target IS NOT NULL
  UNION SELECT target, src FROM match_pairs WHERE src IS NOT NULL AND target IS NOT NULL),
reach(v, g) USING KEY (v) AS (
  SELECT a, min(b) FROM (SELECT a, least(a, b) AS b FROM links) GROUP BY a
  UNION SELECT l.b, min(r.g) FROM reach r JOIN links l ON l.a = r.v JOIN recurring.reach o ON o.v = l.b WHERE r.g < o.g GROUP BY l.b)
SELECT g AS group_id, v AS vertex_id FROM reach"""

ORACLE: dict[str, str] = {
    "p3_found": _RECORDS + "SELECT first_id, rec_id FROM grouped WHERE rec_id > first_id",
    "p3_records": _RECORDS + "SELECT first_id, copies FROM grouped WHERE rec_id = first_id",
    "p4_found": _LABELS + "SELECT label, mark FROM marked WHERE mark IS NOT NULL",
    "p4_labels": _LABELS + "SELECT label, occurrences, n_rows, mark FROM marked",
    "p5_found": _GROUPS,
    "p5_rounds": _GROUPS,
    "p7_found": f"""
WITH {plain_forms.table(True)}, {plain_forms.seen("documents", "doc_id", True, "ds")}, {plain_forms.seen("eval_items", "item_id", True, "es")},
d AS (SELECT key AS doc_id, string_split(trim(regexp_replace(form, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' ') AS w FROM ds WHERE text IS NOT NULL),
i AS (SELECT key AS item_id, string_split(trim(regexp_replace(form, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' ') AS w FROM es WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS g FROM i WHERE len(w) < 10 AND w[1] <> '')
SELECT doc_id, item_id FROM dg JOIN ig USING (g)
UNION SELECT doc_id, item_id FROM d, short WHERE contains(' ' || array_to_string(w, ' ') || ' ', g)""",
    "p8_found": f"""
WITH {plain_forms.table(False)}, {plain_forms.seen("documents", "doc_id")}
SELECT a.key AS doc_id_a, b.key AS doc_id_b FROM seen a JOIN seen b ON a.form = b.form AND a.key < b.key AND a.text <> b.text WHERE a.form <> ''""",
    "p8_forms": f"WITH {plain_forms.table(False)}, {plain_forms.seen('documents', 'doc_id')} SELECT key AS doc_id, form FROM seen",
    "p8_classes": f"""
WITH {plain_forms.table(False)}, {plain_forms.seen("documents", "doc_id")},
c AS (SELECT form, min(key) AS class_id, count(*) AS documents, count(DISTINCT text) AS texts FROM seen WHERE form <> '' GROUP BY form HAVING count(DISTINCT text) > 1)
SELECT key AS doc_id, class_id, documents, texts FROM seen JOIN c USING (form)""",
}
