"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm.copies import collapsed, copy_members
from ringweave.llm.groups import linked_groups
from ringweave.llm.leaks import leaked_items
from ringweave.llm.packing import pack
from ringweave.llm.residue import residue_documents
from ringweave.llm.spans import shared_spans, span_clusters
from ringweave.llm.topn import top_items
from ringweave.plans.tables import table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query(
    "p2_found",
    """
WITH RECURSIVE l AS (
  SELECT qseqid AS a, sseqid AS b FROM matches
  WHERE pident >= 95.0 AND qseqid <> sseqid AND qseqid NOT IN (SELECT gene_id FROM genes) AND sseqid NOT IN (SELECT gene_id FROM genes)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(seq_id, other) AS (SELECT a, a FROM e UNION SELECT r.seq_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT seq_id, min(other) AS group_id FROM r GROUP BY seq_id
""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    genes = table(spark, folder, "genes").select("gene_id")
    links = table(spark, folder, "matches").filter("pident >= 95.0 and qseqid <> sseqid").select("qseqid", "sseqid")
    for end in ("qseqid", "sseqid"):
        links = links.join(genes, F.col(end) == F.col("gene_id"), "left_anti")
    return linked_groups(links, "qseqid", "sseqid")


WINDOWS_SQL = """
r AS (SELECT ref_no, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s FROM df_references WHERE seq IS NOT NULL),
w AS (SELECT ref_no, i, substr(s, i, 60) AS k FROM (SELECT ref_no, s, unnest(generate_series(1, length(s) - 59)) AS i FROM r WHERE length(s) >= 60)),
k AS (SELECT k FROM w WHERE regexp_full_match(k, '[ACGT]{60}') GROUP BY k HAVING count(DISTINCT ref_no) > 1)
"""


@query(
    "p3_found",
    f"""
WITH {WINDOWS_SQL},
h AS (SELECT DISTINCT ref_no, i FROM w SEMI JOIN k USING (k)),
g AS (SELECT ref_no, i, sum(CASE WHEN i <= before + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY ref_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(i) OVER (PARTITION BY ref_no ORDER BY i) AS before FROM h))
SELECT ref_no, CAST(min(i) AS INTEGER) AS span_from, CAST(max(i) + 59 AS INTEGER) AS span_to FROM g GROUP BY ref_no, run
""",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "df_references"), "ref_no", "seq", span=60)


@query(
    "p3_clusters",
    f"""
WITH RECURSIVE {WINDOWS_SQL},
h AS (SELECT DISTINCT ref_no, k FROM w SEMI JOIN k USING (k)),
m AS (SELECT k, min(ref_no) AS c FROM h GROUP BY k),
e AS (SELECT DISTINCT ref_no AS a, c AS b FROM h JOIN m USING (k) WHERE ref_no <> c UNION SELECT DISTINCT c, ref_no FROM h JOIN m USING (k) WHERE ref_no <> c),
t(ref_no, other) AS (SELECT a, a FROM e UNION SELECT t.ref_no, e.b FROM t JOIN e ON e.a = t.other)
SELECT ref_no, min(other) AS cluster FROM t GROUP BY ref_no
""",
)
def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return span_clusters(table(spark, folder, "df_references"), "ref_no", "seq", span=60)


@query(
    "p4_found",
    """
WITH i AS (SELECT qseqid, sseqid, max(bitscore) AS score FROM matches WHERE qseqid <> sseqid AND bitscore IS NOT NULL GROUP BY 1, 2),
r AS (SELECT qseqid, sseqid, row_number() OVER (PARTITION BY qseqid ORDER BY score DESC, sseqid) AS n FROM i)
SELECT qseqid, CAST(n AS INTEGER) AS item_rank, sseqid FROM r WHERE n <= 5
""",
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items(table(spark, folder, "matches").filter("qseqid <> sseqid"), "qseqid", "sseqid", "bitscore", 5)


CANONICAL_SQL = """
c AS (SELECT ref_no, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS s,
      list_sort(list_transform(regexp_extract_all(coalesce(id, ''), '[A-Za-z0-9]+'), lambda w: lower(w))) AS w
      FROM df_references WHERE seq IS NOT NULL)
"""


@query(
    "p5_found",
    f"""
WITH {CANONICAL_SQL},
g AS (SELECT ref_no, min(ref_no) OVER (PARTITION BY s, w) AS first_no FROM c WHERE s <> '')
SELECT first_no AS ref_no, ref_no AS copy_ref_no FROM g WHERE ref_no <> first_no
""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    members = copy_members(table(spark, folder, "df_references"), "ref_no", "id", "seq")
    return members.filter("num <> rep").select(F.col("rep").alias("ref_no"), F.col("num").alias("copy_ref_no"))


@query("p5_collapsed", f"WITH {CANONICAL_SQL} SELECT min(ref_no) AS ref_no, count(*) AS n_copies FROM c WHERE s <> '' GROUP BY s, w")
def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return collapsed(table(spark, folder, "df_references"), "ref_no", "id", "seq")


@query("p6_packed")
def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """No SQL: the tokenizer is not expressible in it; tested for whole texts, fixed capacity and fill instead."""
    return pack(table(spark, folder, "documents"), "doc_id", "text", capacity=2048)


@query(
    "p7_found",
    """
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, lower(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
ew AS (SELECT item_id, lower(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM e WHERE len(w) >= 20))
SELECT DISTINCT item_id, doc_id FROM dw JOIN ew USING (k)
""",
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "eval_items"), "item_id", "text", table(spark, folder, "documents"), "doc_id", "text", passage=20)


@query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """No SQL: templates are mined with a prefix tree; tested on labelled fixtures and against a rule-by-rule loop."""
    return residue_documents(table(spark, folder, "documents"), "doc_id", "text", "file_path")
