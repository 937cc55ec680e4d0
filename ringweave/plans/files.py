"""Queries that write the given tables as files of the supported formats to the shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave.operators import evaluation as E
from ringweave.operators import hits as H
from ringweave.plans.catalog import query
from ringweave.plans.evaluation import PREDS, predictions
from ringweave.plans.graphs import NORMAL, graph
from ringweave.plans.hits import CLASSED_SHORT, SHORT, covered_sql, gene_hits
from ringweave.plans.tables import table
from ringweave.session import Scratch
from ringweave.sources import gfa, reports, sequences, tables


def folder_for(spark, what: str) -> str:
    return f"{Scratch(spark, what).base}/files"


def by_sample(spark, lines):
    """(sample_id, value) as a folder of lines for each sample, read again as a graph's lines."""
    path = folder_for(spark, "gfa")
    lines.write.partitionBy("sample_id").text(path)
    return gfa.read_lines(spark, path)


@query("gfa_segments", f"WITH {NORMAL} SELECT CAST(sample_id AS VARCHAR) AS sample_id, seg_name, seq, length, kmer_count, round(depth, 6) AS depth, round(gc, 6) AS gc FROM ns")
def gfa_segments(spark, folder):
    """The segments written as GFA files, a folder for each sample, and read back."""
    found = gfa.segments(by_sample(spark, gfa.segment_lines(table(spark, folder, "segments"))))
    return found.select("sample_id", "seg_name", "seq", "length", "kmer_count", F.round("depth", 6).alias("depth"), F.round("gc", 6).alias("gc"))


@query("gfa_contigs", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, seg_name, length(seq) AS length FROM segments WHERE seq <> '*'")
def gfa_contigs(spark, folder):
    """Only the sequences of GFA files, with the lengths of these, as for a table of contigs."""
    found = gfa.segments(by_sample(spark, gfa.segment_lines(table(spark, folder, "segments")))).filter("seq <> '*'")
    return found.select("sample_id", "seg_name", F.length("seq").alias("length"))


@query(
    "gfa_links",
    """SELECT CAST(sample_id AS VARCHAR) AS sample_id, from_seg, from_ori, to_seg, to_ori, coalesce(overlap, '*') AS overlap, coalesce(TRY_CAST(left(overlap, length(overlap) - 1) AS INTEGER), 0) AS overlap_length FROM links""",
)
def gfa_links(spark, folder):
    found = gfa.links(by_sample(spark, gfa.link_lines(table(spark, folder, "links"))))
    return found.select("sample_id", "from_seg", "from_ori", "to_seg", "to_ori", "overlap", "overlap_length")


@query(
    "gfa_link_tags",
    """WITH l AS (SELECT sample_id, least(from_seg, to_seg) AS a, greatest(from_seg, to_seg) AS b, length(from_seg) * 7 + length(to_seg) AS quality, count(*) AS n FROM links GROUP BY ALL)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, a, b, CAST(max(quality) AS BIGINT) AS map_quality, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT sample_id, least(from_seg, to_seg) AS a, greatest(from_seg, to_seg) AS b, length(least(from_seg, to_seg)) * 7 + length(greatest(from_seg, to_seg)) AS quality FROM links) GROUP BY sample_id, a, b""",
)
def gfa_link_tags(spark, folder):
    """A tag of links that depends on the pair, looked up by the pair whatever its orientations; repeated lines count once."""
    links = table(spark, folder, "links")
    quality = (F.length(F.least("from_seg", "to_seg")) * 7 + F.length(F.greatest("from_seg", "to_seg"))).cast("string")
    lines = gfa.link_lines(links.withColumn("quality", quality), F.concat(F.lit("MQ:i:"), F.col("quality")))
    found = gfa.links(by_sample(spark, lines))
    counts = found.groupBy("sample_id", F.least("from_seg", "to_seg").alias("a"), F.greatest("from_seg", "to_seg").alias("b")).agg(F.count("*").alias("n"))
    return gfa.link_tags(found).join(counts, ["sample_id", "a", "b"]).select("sample_id", "a", "b", "map_quality", "n")


@query(
    "gfa_containments",
    """SELECT CAST(sample_id AS VARCHAR) AS sample_id, from_seg AS container, from_ori AS container_ori, to_seg AS containee, to_ori AS containee_ori, CAST(length(from_seg) AS INTEGER) AS pos, coalesce(overlap, '*') AS overlap, CAST(length(to_seg) AS BIGINT) AS differences FROM links""",
)
def gfa_containments(spark, folder):
    """Links written as containments."""
    line = F.concat_ws("\t", F.lit("C"), "from_seg", "from_ori", "to_seg", "to_ori", F.length("from_seg").cast("string"), F.coalesce("overlap", F.lit("*")), F.concat(F.lit("NM:i:"), F.length("to_seg").cast("string")))
    found = gfa.containments(by_sample(spark, table(spark, folder, "links").select("sample_id", line.alias("value"))))
    return found.select("sample_id", "container", "container_ori", "containee", "containee_ori", "pos", "overlap", "differences")


@query(
    "gfa_paths",
    """WITH p AS (SELECT *, 'p' || row_number() OVER (PARTITION BY sample_id ORDER BY from_seg, from_ori, to_seg, to_ori, overlap NULLS FIRST) AS path FROM links)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, from_seg || '_' || to_seg AS path, 1 AS step, from_seg AS segment, from_ori AS orientation FROM links
UNION ALL SELECT CAST(sample_id AS VARCHAR), from_seg || '_' || to_seg, 2, to_seg, to_ori FROM links""",
)
def gfa_paths(spark, folder):
    """Links written as paths of two steps."""
    line = F.concat_ws("\t", F.lit("P"), F.concat("from_seg", F.lit("_"), "to_seg"), F.concat("from_seg", "from_ori", F.lit(","), "to_seg", "to_ori"), F.coalesce("overlap", F.lit("*")))
    found = gfa.paths(by_sample(spark, table(spark, folder, "links").select("sample_id", line.alias("value"))))
    return found.select("sample_id", "path", "step", "segment", "orientation")


@query("fasta_genes", "SELECT gene_id AS id, seq FROM genes UNION ALL SELECT 'ref_' || ref_no, regexp_replace(seq, '\\s', '', 'g') FROM df_references WHERE seq IS NOT NULL")
def fasta_genes(spark, folder):
    """Genes and references written as FASTA and read back."""
    path = folder_for(spark, "fasta")
    refs = table(spark, folder, "df_references").filter("seq is not null").select(F.concat(F.lit("ref_"), F.col("ref_no").cast("string")).alias("id"), "seq")
    sequences.write_fasta(table(spark, folder, "genes").select(F.col("gene_id").alias("id"), "seq").unionByName(refs), path, head="id", seq="seq")
    return sequences.read_fasta(spark, path).select("id", "seq")


@query(
    "fasta_counts",
    "SELECT CAST(sample_id AS VARCHAR) AS file, count(*) AS n, count(DISTINCT length(seg_name)) AS n_components FROM segments WHERE seq <> '*' GROUP BY 1",
)
def fasta_counts(spark, folder):
    """Records, and different components that their names end with, of one FASTA file for each sample."""
    path = folder_for(spark, "fasta")
    named = table(spark, folder, "segments").filter("seq <> '*'").withColumn("head", F.concat(F.lit("node_"), "seg_name", F.lit("_component_"), F.length("seg_name").cast("string")))
    sequences.write_fasta(named, path, head="head", seq="seq", by=["sample_id"])
    counts, comps = sequences.record_counts(spark, path), sequences.component_counts(sequences.read_fasta(spark, path))
    return counts.join(comps.withColumnRenamed("n", "n_components"), "file")


@query(
    "extended_database",
    "SELECT id, seq FROM (SELECT id, seq, row_number() OVER (PARTITION BY seq ORDER BY old DESC, id) AS k FROM (SELECT gene_id AS id, seq, true AS old FROM genes UNION ALL SELECT 'copy_' || gene_id, seq, false FROM genes UNION ALL SELECT 'short_' || gene_id, left(seq, 60), false FROM genes)) WHERE k = 1",
)
def extended_database(spark, folder):
    """A database of genes extended by sequences of which some are in it: what was there stays, each sequence once."""
    path = folder_for(spark, "database")
    genes = table(spark, folder, "genes").select(F.col("gene_id").alias("id"), "seq")
    sequences.write_fasta(genes, path, head="id", seq="seq")
    more = genes.select(F.concat(F.lit("copy_"), "id").alias("id"), "seq").unionByName(genes.select(F.concat(F.lit("short_"), "id").alias("id"), F.left("seq", F.lit(60)).alias("seq")))
    sequences.extend_fasta(spark, more, path, head="id", seq="seq")
    return sequences.read_fasta(spark, path).select("id", "seq")


@query(
    "genbank_genes",
    """WITH r AS (SELECT ref_no, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS s FROM df_references WHERE seq IS NOT NULL), l AS (SELECT * FROM r WHERE length(s) >= 100)
SELECT 'R' || ref_no AS record, length(s) AS record_length, 0 AS gene_no, 'tag' || ref_no AS gene_id, substr(s, 11, 50) AS seq FROM l
UNION ALL SELECT 'R' || ref_no, length(s), 1, 'gene1_late', reverse(translate(substr(s, 61, 40), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) FROM l""",
)
def genbank_genes(spark, folder):
    """References written as GenBank records with two genes, one on either strand, and read back."""
    path = folder_for(spark, "genbank")
    letters = F.upper(F.regexp_replace("seq", "[^A-Za-z]+", ""))
    rows = table(spark, folder, "df_references").select("ref_no", letters.alias("s")).filter("length(s) >= 100")
    number, size, pad = F.col("ref_no").cast("string"), F.length("s").cast("string"), " " * 21
    text = F.concat(
        F.lit("LOCUS       R"), number, F.lit("  "), size, F.lit(" bp    DNA\nFEATURES             Location/Qualifiers\n     gene            11..60\n"), F.lit(f'{pad}/locus_tag="tag'), number,
        F.lit(f'"\n     gene            complement(61..100)\n{pad}/gene="late"\nORIGIN\n        1 '), F.lower("s"), F.lit("\n//"),
    )
    rows.select(text).write.text(path)
    return sequences.read_genbank(spark, path).select("record", "record_length", "gene_no", "gene_id", "seq")


@query("hit_files", "SELECT qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore FROM matches")
def hit_files(spark, folder):
    """The hit table written without header and read back."""
    path = folder_for(spark, "hits")
    tables.write_hits(table(spark, folder, "matches"), path)
    return tables.read_hits(spark, path).drop("hit_id")


@query("gene_lists", CLASSED_SHORT + " SELECT DISTINCT qseqid AS value FROM cv WHERE verdict = 'kept'")
def gene_lists(spark, folder):
    """The genes with kept hits written as a list, one a line and in order, and read back."""
    path = folder_for(spark, "list")
    tables.write_list(H.classified(gene_hits(spark, folder), table(spark, folder, "genes"), share=SHORT).filter("verdict = 'kept'"), "qseqid", path)
    return tables.read_list(spark, path)


@query(
    "sample_tables",
    "SELECT CAST(sample_id AS VARCHAR) AS sample_id, organism, trim(p) AS plasmid FROM (SELECT sample_id, organism, unnest(string_split(plasmids, ',')) AS p FROM samples) WHERE trim(p) <> ''",
)
def sample_tables(spark, folder):
    """Samples written with semicolons and header, read as text, and their lists of plasmids split."""
    path = folder_for(spark, "samples")
    tables.write_csv(table(spark, folder, "samples").select("sample_id", "organism", "plasmids"), path, sep=";")
    rows = tables.read_delimited(spark, path).select("sample_id", "organism", F.explode(F.split("plasmids", ",")).alias("p"))
    return rows.select("sample_id", "organism", F.trim("p").alias("plasmid")).filter("plasmid <> ''")


@query(
    "bin_files",
    """WITH m AS (SELECT DISTINCT sample_id, plasmid_id FROM eval_refs WHERE sample_id IS NOT NULL), b AS (SELECT *, dense_rank() OVER (ORDER BY sample_id) - 1 AS i FROM m)
SELECT 'bin_' || i AS bin, plasmid_id AS member FROM b""",
)
def bin_files(spark, folder):
    """The scored plasmids of each sample as a line of one file, and read back by line."""
    path = folder_for(spark, "bins")
    members = table(spark, folder, "eval_refs").filter("sample_id is not null").select(F.col("sample_id").alias("bin_no"), F.col("plasmid_id").alias("member"), F.lit(0).alias("place")).distinct()
    tables.write_bins(members, path)
    return tables.read_bins(spark, path).select("bin", "member")


@query(
    "kept_with_fragments",
    CLASSED_SHORT
    + """, un AS (SELECT gene_id FROM genes WHERE gene_id NOT IN (SELECT qseqid FROM cv WHERE verdict = 'kept') AND gene_id IN (SELECT qseqid FROM gh)),
c AS (SELECT * FROM cv WHERE qseqid IN (SELECT gene_id FROM un) AND pident >= 95.0), st AS (SELECT qseqid, qstart, qend, count(*) AS same FROM c WHERE qstart IS NOT NULL AND qend IS NOT NULL GROUP BY ALL),
ins AS (SELECT DISTINCT a.qseqid, a.qstart, a.qend FROM st a JOIN st b ON a.qseqid = b.qseqid AND b.qstart <= a.qstart AND a.qend <= b.qend AND (a.same > 1 OR a.qstart <> b.qstart OR a.qend <> b.qend)),
f AS (SELECT c.* FROM c ANTI JOIN ins USING (qseqid, qstart, qend)), t AS (SELECT qseqid FROM f GROUP BY 1 HAVING sum(length) >= max(gene_length) * 0.3)
SELECT hit_id, qseqid FROM cv WHERE verdict = 'kept' UNION SELECT hit_id, qseqid FROM f SEMI JOIN t USING (qseqid)""",
)
def kept_with_fragments(spark, folder):
    """Kept hits and, for genes that none of them locates, the fragments that make the gene up together."""
    genes = table(spark, folder, "genes")
    return H.with_fragments(gene_hits(spark, folder), genes, share=SHORT, variant="uncontained")


def cover_pairs(spark, folder):
    """(tool, sample_id, reference, prediction, recall, precision): predictions and references of one tool and sample with a hit between them."""
    refs, preds = references(spark, folder), predictions(spark, folder).filter("sample_id is not null")
    both = preds.select("tool", "sample_id", F.col("plasmid_id").alias("prediction"), F.col("length").alias("p_length")).join(refs.select("tool", "sample_id", F.col("plasmid").alias("reference"), F.col("length").alias("r_length")), ["tool", "sample_id"])
    hits = table(spark, folder, "matches").select(F.col("qseqid").alias("prediction"), F.col("sseqid").alias("reference"), "qstart", "qend", "sstart", "send")
    hits = hits.join(both.select("prediction", "reference").distinct(), ["prediction", "reference"], "left_semi")
    covered = H.covered_sides(hits, ["prediction", "reference"])
    share = lambda n, size: F.least(F.round(F.try_divide(F.coalesce(n, F.lit(0)), size), 6), F.lit(1.0))
    found = both.join(covered, ["prediction", "reference"])
    return found.select("tool", "sample_id", "reference", "prediction", share("s_covered", F.col("r_length")).alias("recall"), share("q_covered", F.col("p_length")).alias("precision"))


def references(spark, folder):
    """(tool, sample_id, plasmid, length, union_recall): repeated rows are one reference."""
    rows = table(spark, folder, "eval_refs").filter("sample_id is not null").groupBy("tool", "sample_id", F.col("plasmid_id").alias("plasmid"))
    return rows.agg(F.max("length").alias("length"), F.round(F.max(F.coalesce("union_recall", F.lit(0.0))), 6).alias("union_recall"))


COVERS = f"""{PREDS}, rf AS (SELECT tool, sample_id, plasmid_id AS plasmid, max(length) AS length, round(max(coalesce(union_recall, 0)), 6) AS union_recall FROM eval_refs WHERE sample_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT tool, sample_id, plasmid_id AS plasmid, length, round(union_precision, 6) AS union_precision FROM pd WHERE sample_id IS NOT NULL),
bo AS (SELECT p.tool, p.sample_id, p.plasmid AS prediction, p.length AS p_length, r.plasmid AS reference, r.length AS r_length FROM pr p JOIN rf r ON p.tool = r.tool AND p.sample_id = r.sample_id),
hp AS (SELECT qseqid AS prediction, sseqid AS reference, qstart, qend, sstart, send FROM matches WHERE (qseqid, sseqid) IN (SELECT (prediction, reference) FROM bo)),
qc AS (WITH {covered_sql('hp', 'prediction, reference', 'qstart', 'qend')} SELECT prediction, reference, covered FROM cov), sc AS (WITH {covered_sql('hp', 'prediction, reference', 'sstart', 'send')} SELECT prediction, reference, covered FROM cov),
cp AS (SELECT tool, sample_id, reference, prediction, least(round(coalesce(s.covered, 0) / r_length, 6), 1) AS recall, least(round(coalesce(q.covered, 0) / p_length, 6), 1) AS precision
  FROM bo JOIN (SELECT DISTINCT prediction, reference FROM hp) USING (prediction, reference) LEFT JOIN qc q USING (prediction, reference) LEFT JOIN sc s USING (prediction, reference)),
gr AS (SELECT tool, sample_id FROM rf INTERSECT SELECT tool, sample_id FROM pr)"""
FILE = "tool || '/' || sample_id AS file"


def sections(spark, folder):
    """Evaluation reports of every tool and sample with predictions, written to the shared folder and read back."""
    path, by = folder_for(spark, "reports"), ["tool", "sample_id"]
    preds = predictions(spark, folder).filter("sample_id is not null").select(*by, F.col("plasmid_id").alias("plasmid"), "length", F.round("union_precision", 6).alias("union_precision"))
    preds = Scratch(spark, "reports").write(preds, "predictions")
    lines = reports.report_lines(references(spark, folder), preds, cover_pairs(spark, folder), by)
    lines.repartition(*by).write.partitionBy(*by).text(path)
    return reports.read_sections(spark, path)


@query(
    "report_references",
    f"""WITH {COVERS} SELECT {FILE}, plasmid, length, coalesce(best, 0) AS best_recall, union_recall FROM rf SEMI JOIN gr USING (tool, sample_id)
LEFT JOIN (SELECT tool, sample_id, reference AS plasmid, max(recall) AS best FROM cp GROUP BY ALL) USING (tool, sample_id, plasmid)""",
)
def report_references(spark, folder):
    return reports.load_scores(sections(spark, folder))[0]


@query(
    "report_predictions",
    f"""WITH {COVERS} SELECT {FILE}, plasmid, length, coalesce(best, 0) AS best_precision, union_precision FROM pr SEMI JOIN gr USING (tool, sample_id)
LEFT JOIN (SELECT tool, sample_id, prediction AS plasmid, max(precision) AS best FROM cp GROUP BY ALL) USING (tool, sample_id, plasmid)""",
)
def report_predictions(spark, folder):
    return reports.load_scores(sections(spark, folder))[1]


@query("report_pairs", f"WITH {COVERS} SELECT {FILE}, reference, prediction, recall, precision FROM cp WHERE recall >= 0.8 AND precision >= 0.8")
def report_pairs(spark, folder):
    """Pairs that cover each other well."""
    return E.high_quality(reports.pairs(sections(spark, folder)), 0.8)


@query(
    "report_coverage",
    f"""WITH {COVERS}, cells AS (SELECT {FILE}, a.prediction AS row_id, b.reference AS column_id, coalesce(c.recall, 0) AS proportion
  FROM (SELECT DISTINCT tool, sample_id, prediction FROM cp) a JOIN (SELECT DISTINCT tool, sample_id, reference FROM cp) b USING (tool, sample_id) LEFT JOIN cp c USING (tool, sample_id, prediction, reference)) SELECT * FROM cells""",
)
def report_coverage(spark, folder):
    """The matrix of how much of each reference each prediction covers, in long form."""
    return reports.coverage(sections(spark, folder), "ref_by_pred")


@query(
    "report_totals",
    f"""WITH {COVERS} SELECT {FILE}, 'references' AS section, count(*) AS n, CAST(sum(length) AS BIGINT) AS length FROM rf SEMI JOIN gr USING (tool, sample_id) GROUP BY 1
UNION ALL SELECT {FILE}, 'predictions', count(*), CAST(sum(length) AS BIGINT) FROM pr SEMI JOIN gr USING (tool, sample_id) GROUP BY 1""",
)
def report_totals(spark, folder):
    """Numbers and lengths of the sequences that the reports list."""
    return reports.section_totals(sections(spark, folder))


@query(
    "report_summaries",
    f"""WITH {COVERS}, r AS (SELECT tool, sample_id, sum(length * union_recall) / sum(length) AS r FROM rf GROUP BY ALL), p AS (SELECT tool, sample_id, sum(length * union_precision) / sum(length) AS p FROM pr GROUP BY ALL)
SELECT {FILE}, s.score, round(s.value, 6) AS value FROM r JOIN p USING (tool, sample_id), LATERAL (SELECT 'recall' AS score, r AS value UNION ALL SELECT 'precision', p UNION ALL SELECT 'overall', CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END) s""",
)
def report_summaries(spark, folder):
    found = reports.summary(sections(spark, folder))
    return found.select("file", "score", F.round("value", 6).alias("value"))


QUALITY = """qr AS (SELECT tool, sample_id, CAST(count(*) AS INTEGER) AS contigs, CAST(max(length) AS INTEGER) AS largest, CAST(sum(length) AS INTEGER) AS total, CAST(count(*) FILTER (union_recall - coalesce(best_recall, 0) > 0.1) AS INTEGER) AS misassemblies
  FROM eval_refs WHERE sample_id IS NOT NULL GROUP BY ALL)"""


def quality(spark, folder):
    """Assembly-quality reports of every sample, a column for each tool that has any there, written and read back."""
    path = folder_for(spark, "quality")
    text = lambda c: c.cast("string")
    rows = table(spark, folder, "eval_refs").filter("sample_id is not null").groupBy("sample_id", "tool").agg(
        text(F.count("*")).alias("# contigs"), text(F.max("length")).alias("Largest contig"), text(F.sum("length")).alias("Total length"),
        text(F.count_if(F.col("union_recall") - F.coalesce("best_recall", F.lit(0.0)) > 0.1)).alias("    # misassemblies"),
    )
    names = [c for c in rows.columns if c not in ("sample_id", "tool")]
    long = rows.select("sample_id", "tool", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))
    reports.quality_lines(long, ["sample_id"]).write.partitionBy("sample_id").text(path)
    return reports.read_quality(spark, path)


@query(
    "quality_metrics",
    f"""WITH {QUALITY} SELECT CAST(s.sample_id AS VARCHAR) AS file, CAST(coalesce(contigs, 0) AS DOUBLE) AS contigs, CAST(coalesce(largest, 0) AS DOUBLE) AS largest, CAST(coalesce(misassemblies, 0) AS DOUBLE) AS misassemblies, contigs IS NULL AS missing
FROM samples s LEFT JOIN (SELECT * FROM qr WHERE tool = 'greedy') q USING (sample_id)""",
)
def quality_metrics(spark, folder):
    """One tool's quality in every sample; zeros where a report lacks the tool or there is no report."""
    files = table(spark, folder, "samples").select(F.col("sample_id").cast("string").alias("file"))
    found = reports.quality_of(quality(spark, folder), files, "greedy", ["contigs", "Largest contig", "misassemblies"])
    return found.withColumnRenamed("Largest contig", "largest")


@query(
    "quality_rates",
    f"""WITH {QUALITY}, r AS (SELECT tool, sample_id, sum(length * coalesce(union_recall, 0)) / sum(length) AS recall FROM eval_refs GROUP BY 1, 2)
SELECT tool, CAST(sample_id AS VARCHAR) AS file, round(1000 * misassemblies / total, 9) AS per_thousand, round(recall, 9) AS recall FROM qr JOIN r USING (tool, sample_id)""",
)
def quality_rates(spark, folder):
    """Misassemblies for 1,000 letters of each tool and sample, from the reports, beside the recall."""
    wide = quality(spark, folder).filter(F.col("metric").isin("misassemblies", "Total length")).groupBy("tool", "file").pivot("metric", ["misassemblies", "Total length"]).agg(F.first(F.col("value").try_cast("double")))
    recall = (F.sum(F.col("length") * F.coalesce("union_recall", F.lit(0.0))) / F.sum("length")).alias("recall")
    scores = table(spark, folder, "eval_refs").groupBy("tool", F.col("sample_id").cast("string").alias("file")).agg(recall)
    rate = 1000 * F.try_divide(F.col("misassemblies"), F.col("Total length"))
    return wide.join(scores, ["tool", "file"]).select("tool", "file", F.round(rate, 9).alias("per_thousand"), F.round("recall", 9).alias("recall"))


@query(
    "misassembly_histogram",
    f"WITH {QUALITY} SELECT tool, 'misassemblies' AS metric, misassemblies AS value, count(*) AS n FROM qr GROUP BY ALL UNION ALL SELECT tool, 'contigs', contigs, count(*) FROM qr GROUP BY ALL",
)
def misassembly_histogram(spark, folder):
    return reports.histogram(quality(spark, folder), ["misassemblies", "contigs"])
