"""Queries on the hit table: genes against references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions.sequences import accession_in, without_version
from ringweave.operators import hits as H
from ringweave.plans.catalog import query
from ringweave.plans.tables import table


def gene_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "matches").join(table(spark, folder, "genes").select(F.col("gene_id").alias("qseqid")), "qseqid", "left_semi")


def contig_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(contig, length): the longest version received of each reference accession."""
    letters = F.length(F.regexp_replace("seq", "[^A-Za-z]+", ""))
    rows = table(spark, folder, "df_references").select(accession_in("id").alias("contig"), letters.alias("length"))
    return rows.filter("contig is not null and length > 0").groupBy("contig").agg(F.max("length").alias("length"))


GENE_HITS = "gh AS (SELECT * FROM matches WHERE qseqid IN (SELECT gene_id FROM genes))"
CONTIGS = """ct AS (SELECT 'NZ_PL' || regexp_extract(id, '(?i)NZ[^A-Za-z0-9]?PL([0-9]+)\\.[0-9]+', 1) || '.' || regexp_extract(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.([0-9]+)', 1) AS contig,
  CAST(max(length(regexp_replace(seq, '[^A-Za-z]', '', 'g'))) AS INTEGER) AS length FROM df_references
  WHERE regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') AND length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) > 0 GROUP BY 1)"""


def covered_sql(source: str, keys: str, a: str, b: str) -> str:
    """Covered positions by keys, as a chain of common table expressions that ends in cov."""
    return f"""ci AS (SELECT DISTINCT {keys}, least({a}, {b}) AS a, greatest({a}, {b}) AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
co AS (SELECT *, max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ci),
cov AS (SELECT {keys}, CAST(sum(greatest(0, b - greatest(coalesce(reach, a - 1) + 1, a) + 1)) AS BIGINT) AS covered FROM co GROUP BY {keys})"""


CLASSED = f"""WITH {GENE_HITS},
cl AS (SELECT gh.*, CAST(length(g.seq) AS INTEGER) AS gene_length FROM gh JOIN genes g ON g.gene_id = gh.qseqid),
cv AS (SELECT *, CASE WHEN coalesce(pident, 0) < 95.0 THEN 'identity' WHEN coalesce(length, 0) / gene_length < 0.95 THEN 'length' ELSE 'kept' END AS verdict FROM cl)"""


#: The given hits are much shorter than their genes; with this share some pass and others do not.
SHORT = 0.3
CLASSED_SHORT = CLASSED.replace("/ gene_length < 0.95", f"/ gene_length < {SHORT}")


@query("filter_hits", CLASSED + " SELECT hit_id, qseqid, sseqid, verdict FROM cv")
def filter_hits(spark, folder):
    return H.classified(gene_hits(spark, folder), table(spark, folder, "genes")).select("hit_id", "qseqid", "sseqid", "verdict")


@query("unknown_genes", "SELECT DISTINCT qseqid FROM matches WHERE qseqid NOT IN (SELECT gene_id FROM genes)")
def unknown_genes(spark, folder):
    return H.unknown_genes(table(spark, folder, "matches"), table(spark, folder, "genes"))


@query("unknown_contigs", f"WITH {CONTIGS} SELECT DISTINCT sseqid FROM matches WHERE sseqid NOT IN (SELECT contig FROM ct)")
def unknown_contigs(spark, folder):
    """Subjects of the hit table that are no received reference."""
    return H.unknown_contigs(table(spark, folder, "matches"), contig_lengths(spark, folder))


REMAP = """nw AS (SELECT string_split(contig, '.')[1] AS base, max(CAST(string_split(contig, '.')[2] AS INTEGER)) AS version FROM ct GROUP BY 1)"""


@query(
    "remapped_hits",
    f"WITH {CONTIGS}, {REMAP} SELECT base || '.' || version AS contig, count(*) AS n_hits FROM matches JOIN nw ON base = string_split(sseqid, '.')[1] GROUP BY 1",
)
def remapped_hits(spark, folder):
    """Hits counted by the newest received version of their subject's accession."""
    versions = contig_lengths(spark, folder).select(without_version("contig").alias("base"), F.substring_index("contig", ".", -1).cast("int").alias("version"))
    newest = versions.groupBy("base").agg(F.max("version").alias("version")).select("base", F.concat_ws(".", "base", F.col("version").cast("string")).alias("contig"))
    counts = table(spark, folder, "matches").groupBy(without_version("sseqid").alias("base")).agg(F.count("*").alias("n_hits"))
    return counts.join(newest, "base").select("contig", "n_hits")


@query(
    "hit_classes",
    CLASSED_SHORT + """ SELECT gene_id, coalesce(n, 0) AS n_hits, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS hit_class
FROM genes LEFT JOIN (SELECT qseqid, count(*) AS n FROM cv WHERE verdict = 'kept' GROUP BY 1) ON gene_id = qseqid""",
)
def hit_classes(spark, folder):
    """Genes by the number of hits that pass the filter."""
    genes = table(spark, folder, "genes")
    return H.hit_classes(H.classified(gene_hits(spark, folder), genes, share=SHORT).filter("verdict = 'kept'"), genes)


@query("unlocated_genes", CLASSED_SHORT + " SELECT gene_id FROM genes WHERE gene_id NOT IN (SELECT qseqid FROM cv WHERE verdict = 'kept') AND gene_id IN (SELECT qseqid FROM gh)")
def unlocated_genes(spark, folder):
    hits, genes = gene_hits(spark, folder), table(spark, folder, "genes")
    return H.unlocated(H.classified(hits, genes, share=SHORT).filter("verdict = 'kept'"), hits, genes)


@query("covered_bases", f"WITH {GENE_HITS}, {covered_sql('gh', 'sseqid', 'sstart', 'send')} SELECT sseqid, covered FROM cov")
def covered_bases(spark, folder):
    return H.covered_bases(gene_hits(spark, folder), "sseqid", "sstart", "send")


@query(
    "gene_density",
    f"""WITH {GENE_HITS}, {CONTIGS}, {covered_sql('gh', 'sseqid', 'sstart', 'send')},
n AS (SELECT sseqid, count(*) AS n_hits, count(DISTINCT CASE WHEN sstart IS NOT NULL AND send IS NOT NULL THEN (sstart, send) END) AS n_locations, count(DISTINCT qseqid) AS n_genes FROM gh GROUP BY 1)
SELECT contig, length, coalesce(n_hits, 0) AS n_hits, coalesce(n_locations, 0) AS n_locations, coalesce(n_genes, 0) AS n_genes, coalesce(covered, 0) AS covered,
  coalesce(covered, 0) / length AS density, coalesce(n_hits, 0) / length AS frequency
FROM ct LEFT JOIN n ON n.sseqid = contig LEFT JOIN cov ON cov.sseqid = contig""",
)
def gene_density(spark, folder):
    return H.densities(gene_hits(spark, folder), contig_lengths(spark, folder))


CONTAINED = """good AS (SELECT * FROM gh WHERE qstart IS NOT NULL AND qend IS NOT NULL),
st AS (SELECT qseqid, qstart, qend, count(*) AS same FROM good GROUP BY ALL),
ins AS (SELECT DISTINCT a.qseqid, a.qstart, a.qend FROM st a JOIN st b ON a.qseqid = b.qseqid AND b.qstart <= a.qstart AND a.qend <= b.qend AND (a.same > 1 OR a.qstart <> b.qstart OR a.qend <> b.qend))"""


@query("contained_hits", f"WITH {GENE_HITS}, {CONTAINED} SELECT hit_id, qseqid FROM good SEMI JOIN ins USING (qseqid, qstart, qend)")
def contained_hits(spark, folder):
    return H.contained(gene_hits(spark, folder)).select("hit_id", "qseqid")


@query(
    "pairwise_overlaps",
    f"""WITH {GENE_HITS},
st AS (SELECT qseqid, least(qstart, qend) AS a, greatest(qstart, qend) AS b, count(*) AS m FROM gh WHERE qstart IS NOT NULL AND qend IS NOT NULL GROUP BY ALL),
within AS (SELECT qseqid, sum(m * (m - 1) / 2 * (b - a + 1)) AS o FROM st GROUP BY 1),
across AS (SELECT x.qseqid, sum(x.m * y.m * (least(x.b, y.b) - greatest(x.a, y.a) + 1)) AS o FROM st x JOIN st y ON x.qseqid = y.qseqid AND (x.a, x.b) < (y.a, y.b) AND y.a <= x.b GROUP BY 1)
SELECT qseqid, CAST(within.o + coalesce(across.o, 0) AS BIGINT) AS overlap FROM within LEFT JOIN across USING (qseqid)""",
)
def pairwise_overlaps(spark, folder):
    return H.pairwise_overlaps(gene_hits(spark, folder))


GOOD_95 = GENE_HITS.replace("WHERE", "WHERE pident >= 90.0 AND")
FRAGMENT_ENOUGH = """un AS (SELECT gh.* FROM gh ANTI JOIN ins USING (qseqid, qstart, qend)),
aj AS (SELECT un.*, length(g.seq) AS gl FROM un JOIN genes g ON g.gene_id = un.qseqid)"""


@query("fragments_simple", f"WITH {GOOD_95}, t AS (SELECT qseqid FROM gh JOIN genes ON gene_id = qseqid GROUP BY qseqid HAVING sum(gh.length) >= max(length(seq)) * 0.95) SELECT hit_id, qseqid FROM gh SEMI JOIN t USING (qseqid)")
def fragments_simple(spark, folder):
    return H.fragmented(gene_hits(spark, folder), table(spark, folder, "genes"), variant="simple", identity=0.90)


@query(
    "fragments_uncontained",
    f"WITH {GOOD_95}, {CONTAINED}, {FRAGMENT_ENOUGH}, t AS (SELECT qseqid FROM aj GROUP BY 1 HAVING sum(length) >= max(gl) * 0.3) SELECT hit_id, qseqid FROM un SEMI JOIN t USING (qseqid)",
)
def fragments_uncontained(spark, folder):
    return H.fragmented(gene_hits(spark, folder), table(spark, folder, "genes"), variant="uncontained", identity=0.90, share=0.3)


@query(
    "fragments_limited",
    f"""WITH {GOOD_95}, {CONTAINED}, {FRAGMENT_ENOUGH}, {covered_sql('un', 'qseqid', 'qstart', 'qend')},
ov AS (SELECT x.qseqid, sum(least(x.qend, y.qend) - greatest(x.qstart, y.qstart) + 1) AS o FROM un x JOIN un y ON x.qseqid = y.qseqid AND (x.qstart, x.qend) < (y.qstart, y.qend) AND y.qstart <= x.qend GROUP BY 1),
t AS (SELECT cov.qseqid FROM cov JOIN genes ON gene_id = cov.qseqid LEFT JOIN ov ON ov.qseqid = cov.qseqid WHERE covered >= length(seq) * 0.3 AND coalesce(o, 0) <= 2000)
SELECT hit_id, qseqid FROM un SEMI JOIN t USING (qseqid)""",
)
def fragments_limited(spark, folder):
    return H.fragmented(gene_hits(spark, folder), table(spark, folder, "genes"), variant="limited", identity=0.90, share=0.3, overlap=2000)


@query(
    "oriented_intervals",
    f"""WITH {GENE_HITS}, {CONTIGS},
z AS (SELECT hit_id, least(sstart, send) - 1 AS a, greatest(sstart, send) - 1 AS b, length AS contig_length, CASE WHEN sstart <= send THEN '+' ELSE '-' END AS strand
      FROM (SELECT hit_id, sseqid, sstart, send FROM gh WHERE sstart IS NOT NULL AND send IS NOT NULL) h JOIN ct ON contig = sseqid)
SELECT hit_id, CASE WHEN strand = '-' THEN contig_length - b ELSE a END AS "start", CASE WHEN strand = '-' THEN contig_length - a ELSE b END AS "end" FROM z""",
)
def oriented_intervals(spark, folder):
    """Normalised ends, 0-based, seen from the strand of the hit."""
    from ringweave.functions.sequences import flip

    hits = gene_hits(spark, folder).filter("sstart is not null and send is not null").select("hit_id", "sseqid", "sstart", "send")
    hits = hits.join(contig_lengths(spark, folder).withColumnRenamed("length", "contig_length"), F.col("sseqid") == F.col("contig"))
    strand = F.when(F.col("sstart") <= F.col("send"), "+").otherwise("-")
    return hits.select("hit_id", *flip(F.least("sstart", "send") - 1, F.greatest("sstart", "send") - 1, F.col("contig_length"), strand))


@query(
    "ring_coverage",
    f"""WITH {GENE_HITS},
z AS (SELECT sseqid, CAST(least(sstart, send) - 1 AS BIGINT) AS a, CAST(greatest(sstart, send) - 1 AS BIGINT) AS b FROM gh WHERE sstart IS NOT NULL AND send IS NOT NULL),
r AS (SELECT sseqid, a % 400 AS a, b % 400 AS b, b - a + 1 >= 400 AS whole FROM z),
w AS (SELECT sseqid, 0 AS a, 399 AS b FROM r WHERE whole UNION ALL SELECT sseqid, a, b FROM r WHERE NOT whole AND a <= b
      UNION ALL SELECT sseqid, a, 399 FROM r WHERE NOT whole AND a > b UNION ALL SELECT sseqid, 0, b FROM r WHERE NOT whole AND a > b),
{covered_sql('w', 'sseqid', 'a', 'b')} SELECT sseqid, covered FROM cov""",
)
def ring_coverage(spark, folder):
    """Coverage of contigs laid around a ring of 400 positions; pieces that cross an end of the ring go on at its start."""
    from ringweave.functions.sequences import wrapped

    hits = gene_hits(spark, folder).filter("sstart is not null and send is not null")
    pieces = hits.select("sseqid", F.inline(wrapped(F.least("sstart", "send").cast("bigint") - 1, F.greatest("sstart", "send").cast("bigint") - 1, F.lit(400))))
    return H.covered_bases(pieces, "sseqid", "start", "end")


@query("gene_contigs", f"WITH {GENE_HITS} SELECT DISTINCT qseqid AS gene_id, sseqid AS contig FROM gh")
def gene_contigs(spark, folder):
    """Which genes lie on which contigs."""
    return gene_hits(spark, folder).select(F.col("qseqid").alias("gene_id"), F.col("sseqid").alias("contig")).distinct()


@query(
    "gene_spread",
    f"WITH {GENE_HITS} SELECT gene_id, count(DISTINCT sseqid) AS n_contigs, count(DISTINCT CASE WHEN sstart IS NOT NULL AND send IS NOT NULL THEN (sseqid, sstart, send) END) AS n_locations FROM genes LEFT JOIN gh ON qseqid = gene_id GROUP BY 1",
)
def gene_spread(spark, folder):
    """Contigs and locations of each gene, 0 for genes without hits."""
    counts = gene_hits(spark, folder).groupBy(F.col("qseqid").alias("gene_id")).agg(F.count_distinct("sseqid").alias("c"), F.count_distinct("sseqid", "sstart", "send").alias("l"))
    joined = table(spark, folder, "genes").select("gene_id").join(counts, "gene_id", "left")
    return joined.select("gene_id", F.coalesce("c", F.lit(0)).alias("n_contigs"), F.coalesce("l", F.lit(0)).alias("n_locations"))
