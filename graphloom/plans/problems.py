"""Registered queries of the two general data problems, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.edge_lines import load_edge_lines, refused_lines, valid_edges
from graphloom.operators.quantiles import per_key_quantiles


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _per_src(spark: SparkSession, sf: str) -> DataFrame:
    return per_key_quantiles(_table(spark, sf, "edges"), "src", "target", (0.25, 0.5, 0.75), hot_share=0.02)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _per_src(spark, sf).where("hot").select("src")


def p1_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Out-degree and quartiles of the target ids of every src."""
    return _per_src(spark, sf)


def p1_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the delay from observation to loading, in seconds, of every src."""
    edges = _table(spark, sf, "edges").select("src", F.floor((F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 1_000_000).cast("long").alias("delay"))
    return per_key_quantiles(edges, "src", "delay", (0.5, 0.9, 1.0), hot_share=0.02)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return refused_lines(load_edge_lines(_table(spark, sf, "raw_edge_lines"), _table(spark, sf, "feeds"))).select("line_id", "reason")


def p2_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The valid edges, typed."""
    loaded = valid_edges(load_edge_lines(_table(spark, sf, "raw_edge_lines"), _table(spark, sf, "feeds")))
    return loaded.select("line_id", "src", "target", F.col("weight").cast("double").alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_quantiles, p1_delays, p2_found, p2_edges)}


def _ranked(value: str, probs: tuple[float, ...]) -> str:
    picks = ", ".join(f"max(CASE WHEN r = greatest(1, CAST(ceil(n * CAST({p} AS DOUBLE)) AS BIGINT)) THEN v END) AS q{i}" for i, p in enumerate(probs))
    return f"""
WITH e AS (SELECT src, {value} AS v FROM edges WHERE src IS NOT NULL),
ranked AS (SELECT src, v, row_number() OVER (PARTITION BY src ORDER BY v) AS r, count(*) OVER (PARTITION BY src) AS n FROM e WHERE v IS NOT NULL),
q AS (SELECT src, {picks} FROM ranked GROUP BY src),
totals AS (SELECT src, count(*) AS n_rows, count(v) AS n_values, count(*) > 0.02 * (SELECT count(*) FROM e) AS hot FROM e GROUP BY src)
SELECT t.*, {", ".join(f"q{i}" for i in range(len(probs)))} FROM totals t LEFT JOIN q USING (src)"""


#: The shape of a valid line, by regular expressions over the whole line, for each delimiter.
_LINES = r"""
WITH raw AS (
  SELECT r.line_id, CASE f.delim WHEN 'comma' THEN ',' WHEN 'tab' THEN chr(9) ELSE ' ' END AS d, CASE f.delim WHEN 'space' THEN '' ELSE ' *' END AS p,
    CASE WHEN r.line LIKE '%' || chr(13) THEN left(r.line, length(r.line) - 1) ELSE r.line END AS line
  FROM raw_edge_lines r JOIN feeds f USING (feed_id)
  WHERE r.line IS NOT NULL AND left(r.line, 1) NOT IN ('#', '%') AND regexp_matches(r.line, '[^\s]')),
shaped AS (
  SELECT *, '(?:' || p || '"(?:[^"]|"")*"' || p || '|' || CASE d WHEN ' ' THEN '[^" ]*' ELSE ' *(?:[^" ' || d || '][^"' || d || ']*)?' END || ')' AS f FROM raw),
cut AS (
  SELECT line_id, d, line, regexp_full_match(line, f || '(?:' || d || f || ')*') AS quoted, regexp_full_match(line, f || '(?:' || d || f || '){2}') AS three,
    list_transform([regexp_extract(line, '^(' || f || ')' || d, 1), regexp_extract(line, '^' || f || d || '(' || f || ')' || d, 1), regexp_extract(line, '^' || f || d || f || d || '(' || f || ')$', 1)],
      lambda x : CASE WHEN d = ' ' THEN x ELSE trim(x, ' ') END) AS fields FROM shaped),
bare AS (
  SELECT line_id, quoted, three, list_transform(fields, lambda x : CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM cut),
typed AS (
  SELECT *, CASE WHEN regexp_full_match(v[1], '[+-]?[0-9]+') THEN TRY_CAST(regexp_replace(v[1], '^([+-]?)0*([0-9])', '\1\2') AS DOUBLE) END AS s,
    CASE WHEN regexp_full_match(v[2], '[+-]?[0-9]+') THEN TRY_CAST(v[2] AS DOUBLE) END AS t,
    CASE WHEN regexp_full_match(v[3], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(v[3] AS DOUBLE) END AS w FROM bare),
judged AS (
  SELECT line_id, s, t, w, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT three THEN 'columns' WHEN s IS NULL OR s NOT BETWEEN -2147483648 AND 2147483647 THEN 'src'
    WHEN t IS NULL OR t NOT BETWEEN -2147483648 AND 2147483647 THEN 'target' WHEN w IS NULL OR NOT abs(w) < 3.4028235677973366e38 THEN 'weight' END AS reason FROM typed)
"""

ORACLE: dict[str, str] = {
    "p1_found": "SELECT src FROM edges WHERE src IS NOT NULL GROUP BY src HAVING count(*) > 0.02 * (SELECT count(src) FROM edges)",
    "p1_quantiles": _ranked("target", (0.25, 0.5, 0.75)),
    "p1_delays": _ranked("CAST(floor((epoch_us(loaded_at) - epoch_us(observed_at)) / 1000000) AS BIGINT)", (0.5, 0.9, 1.0)),
    "p2_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_edges": _LINES + "SELECT line_id, CAST(s AS INTEGER) AS src, CAST(t AS INTEGER) AS target, CAST(CAST(w AS FLOAT) AS DOUBLE) AS weight FROM judged WHERE reason IS NULL",
}
