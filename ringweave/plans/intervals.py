"""Queries of problem 1 (intervals of pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringweave.operators.sweep import pair_stretches
from ringweave.plans.catalog import query
from ringweave.plans.tables import table

P1_SQL = """
WITH e AS (
  SELECT DISTINCT qseqid, sseqid, 'q' AS side, least(qstart, qend) AS a, greatest(qstart, qend) AS b FROM matches WHERE qstart IS NOT NULL AND qend IS NOT NULL
  UNION
  SELECT qseqid, sseqid, 's', least(sstart, send), greatest(sstart, send) FROM matches WHERE sstart IS NOT NULL AND send IS NOT NULL
), o AS (
  SELECT *, max(b) OVER (PARTITION BY qseqid, sseqid, side ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qseqid, sseqid, side ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM o
), p AS (
  SELECT qseqid, sseqid, side, run, min(a) AS pos_from, max(b) AS pos_to FROM g GROUP BY 1, 2, 3, 4
), n AS (
  SELECT *, lead(pos_from) OVER (PARTITION BY qseqid, sseqid, side ORDER BY pos_from) AS next_from FROM p
)
SELECT qseqid, sseqid, side, 'period' AS kind, pos_from, pos_to FROM n
UNION ALL
SELECT qseqid, sseqid, side, 'gap', CAST(pos_to + 1 AS INTEGER), CAST(next_from - 1 AS INTEGER) FROM n WHERE next_from IS NOT NULL
"""


@query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_stretches(table(spark, folder, "matches"))
