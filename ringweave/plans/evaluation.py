"""Queries on references, scores and translocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave.functions import sequences as S
from ringweave.operators import evaluation as E
from ringweave.operators import references as R
from ringweave.operators import weighted as W
from ringweave.plans.catalog import SQL, query
from ringweave.plans.hits import CONTIGS, contig_lengths, covered_sql
from ringweave.plans.tables import table

LETTERS = "upper(regexp_replace(seq, '[^A-Za-z]', '', 'g'))"
REFS = f"rf AS (SELECT ref_no, id, {LETTERS} AS s, sample_id, release_date FROM df_references WHERE length({LETTERS}) > 0)"
ACC = "'NZ_PL' || regexp_extract(id, '(?i)NZ[^A-Za-z0-9]?PL([0-9]+)\\.[0-9]+', 1) || '.' || regexp_extract(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.([0-9]+)', 1)"
SPECIES = "sp AS (SELECT sample_id, array_to_string(list_slice(string_split(lower(organism), ' '), 1, 2), ' ') AS species FROM samples WHERE organism IS NOT NULL)"
RC = "reverse(translate({}, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"


def references(spark, folder):
    """Records with letters: (ref_no, id, s, sample_id, release_date)."""
    letters = F.upper(F.regexp_replace("seq", "[^A-Za-z]+", ""))
    return table(spark, folder, "df_references").withColumn("s", letters).filter("length(s) > 0").select("ref_no", "id", "s", "sample_id", "release_date")


TRANS = f"""{CONTIGS}, mm AS (SELECT qseqid, sseqid, qstart, qend FROM matches WHERE qseqid <> sseqid AND qseqid NOT IN (SELECT gene_id FROM genes)),
pp AS (WITH {covered_sql('mm', 'qseqid, sseqid', 'qstart', 'qend')} SELECT * FROM cov), aa AS (WITH {covered_sql('mm', 'qseqid', 'qstart', 'qend')} SELECT qseqid, covered AS any_covered FROM cov),
bb AS (SELECT qseqid, sseqid AS partner, covered FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY covered DESC, sseqid) AS k FROM pp) WHERE k = 1),
tl AS (SELECT contig, length, partner, least(coalesce(covered, 0), length) / length AS matched, (least(coalesce(any_covered, 0), length) - least(coalesce(covered, 0), length)) / length AS translocated,
  (length - least(coalesce(any_covered, 0), length)) / length AS unaligned FROM ct LEFT JOIN bb ON bb.qseqid = contig LEFT JOIN aa ON aa.qseqid = contig)"""


def reference_translocations(spark, folder):
    hits = table(spark, folder, "matches").join(table(spark, folder, "genes").select(F.col("gene_id").alias("qseqid")), "qseqid", "left_anti")
    return E.translocations(hits, contig_lengths(spark, folder))


def predictions(spark, folder):
    """Received sequences as predictions of the tools that score an accession of theirs: shares of each that the hits with its best partner, and with any, cover."""
    scored = table(spark, folder, "eval_refs").select("tool", "sample_id", F.col("plasmid_id").alias("contig")).distinct()
    found = reference_translocations(spark, folder).select("contig", "length", F.col("matched").alias("best_precision"), (F.col("matched") + F.col("translocated")).alias("union_precision"))
    return scored.join(found, "contig").select("tool", "sample_id", F.col("contig").alias("plasmid_id"), "length", "best_precision", "union_precision")


PREDS = f"""{TRANS}, pd AS (SELECT tool, sample_id, plasmid_id, tl.length, matched AS best_precision, matched + translocated AS union_precision
  FROM (SELECT DISTINCT tool, sample_id, plasmid_id FROM eval_refs) JOIN tl ON contig = plasmid_id)"""


def scores_sql(keys: str, refs: str = "eval_refs", preds: str = "pd") -> str:
    k = keys.replace(" ", "").split(",")
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM r.{c}" for c in k)
    return f"""SELECT {", ".join(f"x.{c}" for c in k)}, e.evaluation, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (
  SELECT {", ".join(f"r.{c}" for c in k)}, rb, ru, coalesce(pb, 0) AS pb, coalesce(pu, 0) AS pu
  FROM (SELECT {keys}, sum(length * coalesce(best_recall, 0)) / sum(length) AS rb, sum(length * coalesce(union_recall, 0)) / sum(length) AS ru FROM {refs} GROUP BY {keys}) r
  LEFT JOIN (SELECT {keys}, sum(length * best_precision) / sum(length) AS pb, sum(length * union_precision) / sum(length) AS pu FROM {preds} GROUP BY {keys}) p ON {same}) x,
  LATERAL (SELECT 'best' AS evaluation, pb AS p, rb AS r UNION ALL SELECT 'union', pu, ru) e"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("tool_scores", f"WITH {PREDS} {scores_sql('tool')}")
def tool_scores(spark, folder):
    return rounded(E.scores(table(spark, folder, "eval_refs"), predictions(spark, folder), ["tool"]), "precision", "recall", "f1")


@query("sample_scores", f"WITH {PREDS} {scores_sql('tool, sample_id')}")
def sample_scores(spark, folder):
    return rounded(E.scores(table(spark, folder, "eval_refs"), predictions(spark, folder), ["tool", "sample_id"]), "precision", "recall", "f1")




@query("species_scores", f"WITH {SPECIES}, {PREDS}, rs AS (SELECT * FROM eval_refs JOIN sp USING (sample_id)), ps AS (SELECT * FROM pd JOIN sp USING (sample_id)) {scores_sql('species, tool', 'rs', 'ps')}")
def species_scores(spark, folder):
    names = table(spark, folder, "samples").filter("organism is not null").select("sample_id", S.species(F.lower("organism")).alias("species"))
    joined = [df.join(names, "sample_id") for df in (table(spark, folder, "eval_refs"), predictions(spark, folder))]
    return rounded(E.scores(*joined, ["species", "tool"]), "precision", "recall", "f1")


@query("species_totals", f"WITH {SPECIES} SELECT species, CAST(sum(CAST(trunc(length * coalesce(union_recall, 0)) AS BIGINT)) AS BIGINT) AS recalled, CAST(sum(length) AS BIGINT) AS total FROM eval_refs JOIN sp USING (sample_id) GROUP BY 1")
def species_totals(spark, folder):
    names = table(spark, folder, "samples").filter("organism is not null").select("sample_id", S.species(F.lower("organism")).alias("species"))
    return E.truncated_totals(table(spark, folder, "eval_refs").join(names, "sample_id"), ["species"])


@query(
    "organism_names",
    "SELECT sample_id, array_to_string(list_slice(string_split(organism, ' '), 1, 2), ' ') AS species, array_to_string(list_transform(string_split(organism, ' '), lambda w: left(w, 1)), '.') || '.' AS abbreviation FROM samples",
)
def organism_names(spark, folder):
    return table(spark, folder, "samples").select("sample_id", S.species("organism").alias("species"), S.abbreviation("organism").alias("abbreviation"))


@query(
    "baseline_differences",
    f"WITH {PREDS}, s AS ({scores_sql('tool, sample_id')}), u AS (SELECT * FROM s WHERE evaluation = 'union') SELECT a.sample_id, a.tool, round(b.f1 - a.f1, 8) AS difference FROM u a JOIN u b USING (sample_id) WHERE a.tool <> 'greedy' AND b.tool = 'greedy'",
)
def baseline_differences(spark, folder):
    return E.differences(sample_scores(spark, folder).filter("evaluation = 'union'"), "greedy", "f1").withColumn("difference", F.round("difference", 8))


@query(
    "score_distribution",
    """SELECT tool, min(union_recall) AS minimum, round(avg(union_recall), 9) AS mean, round(stddev_samp(union_recall), 9) AS sd, round(quantile_cont(union_recall, 0.25), 9) AS q25,
round(quantile_cont(union_recall, 0.5), 9) AS median, round(quantile_cont(union_recall, 0.75), 9) AS q75, max(union_recall) AS maximum FROM eval_refs GROUP BY 1""",
)
def score_distribution(spark, folder):
    return rounded(W.distribution(table(spark, folder, "eval_refs"), ["tool"], "union_recall"), "mean", "sd", "q25", "median", "q75")


@query(
    "one_way_counts",
    """SELECT tool, count(*) AS n, count(*) FILTER (coalesce(best_recall, 0) >= 0.9) AS n_best, count(*) FILTER (coalesce(union_recall, 0) >= 0.9) AS n_union,
round(sum(CASE WHEN coalesce(best_recall, 0) >= 0.9 THEN length ELSE 0 END) / sum(length), 9) AS length_share FROM eval_refs GROUP BY 1""",
)
def one_way_counts(spark, folder):
    return rounded(E.one_way(table(spark, folder, "eval_refs")), "length_share")


@query("high_quality_pairs", "SELECT tool, sample_id, plasmid_id FROM eval_refs WHERE best_recall >= 0.9 AND union_recall >= 0.9")
def high_quality_pairs(spark, folder):
    pairs = table(spark, folder, "eval_refs").select("tool", "sample_id", "plasmid_id", F.col("best_recall").alias("recall"), F.col("union_recall").alias("precision"))
    return E.high_quality(pairs).select("tool", "sample_id", "plasmid_id")


@query(
    "zero_filled_scores",
    """WITH w AS (SELECT tool, s.sample_id FROM (SELECT DISTINCT tool FROM eval_refs) CROSS JOIN samples s), t AS (SELECT tool, sample_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS nt FROM eval_refs WHERE union_recall >= 0.95 GROUP BY 1, 2)
SELECT tool, sample_id, coalesce(n, 0) AS n, coalesce(nt, 0) AS nt, n IS NULL AS missing FROM w LEFT JOIN t USING (tool, sample_id)""",
)
def zero_filled_scores(spark, folder):
    """Every tool and sample; tools and samples are both fixed in number."""
    refs = table(spark, folder, "eval_refs")
    rows = refs.filter("union_recall >= 0.95").groupBy("tool", "sample_id").agg(F.count("*").alias("n"), F.sum("length").cast("bigint").alias("nt"))
    tools = refs.groupBy().agg(F.collect_set("tool").alias("t")).select(F.explode("t").alias("tool"))
    wanted = table(spark, folder, "samples").select("sample_id").join(tools, F.lit(True))
    return E.zero_filled(rows, wanted, ["tool", "sample_id"], ["n", "nt"])


@query(
    "score_metrics_long",
    """SELECT tool, plasmid_id, m.metric, m.value FROM eval_refs, LATERAL (SELECT 'length' AS metric, CAST(length AS DOUBLE) AS value UNION ALL SELECT 'best_recall', best_recall UNION ALL SELECT 'union_recall', union_recall) m""",
)
def score_metrics_long(spark, folder):
    return E.unpivoted(table(spark, folder, "eval_refs"), ["tool", "plasmid_id"], ["length", "best_recall", "union_recall"], kind="double")


@query(
    "reference_counts",
    """SELECT s.sample_id, coalesce(n_listed, 0) AS n_listed, coalesce(n_received, 0) AS n_received FROM samples s
LEFT JOIN (SELECT sample_id, count(*) AS n_listed FROM (SELECT sample_id, unnest(string_split(plasmids, ',')) AS p FROM samples) WHERE trim(p) <> '' GROUP BY 1) l ON l.sample_id = s.sample_id
LEFT JOIN (SELECT sample_id, count(*) AS n_received FROM df_references GROUP BY 1) r ON r.sample_id = s.sample_id""",
)
def reference_counts(spark, folder):
    """Listed and received plasmids of each sample."""
    samples = table(spark, folder, "samples")
    listed = samples.select("sample_id", F.explode(F.split("plasmids", ",")).alias("p")).filter("trim(p) <> ''").groupBy("sample_id").agg(F.count("*").alias("n_listed"))
    received = table(spark, folder, "df_references").groupBy("sample_id").agg(F.count("*").alias("n_received"))
    joined = samples.select("sample_id").join(listed, "sample_id", "left").join(received, "sample_id", "left")
    return joined.select("sample_id", F.coalesce("n_listed", F.lit(0)).alias("n_listed"), F.coalesce("n_received", F.lit(0)).alias("n_received"))


@query(
    "accessions",
    f"""SELECT ref_no, CASE WHEN regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') THEN {ACC} END AS accession,
CASE WHEN regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') THEN string_split({ACC}, '.')[1] END AS base FROM df_references""",
)
def accessions(spark, folder):
    rows = table(spark, folder, "df_references").select("ref_no", S.accession_in("id").alias("accession"))
    return rows.withColumn("base", S.without_version("accession"))


@query(
    "replicons",
    """WITH l AS (SELECT sample_id, trim(unnest(string_split(plasmids, ','))) AS p FROM samples) SELECT sample_id, p AS refseq, CASE WHEN sample_id % 2 = 0 THEN substr(p, 4) END AS genbank, CASE WHEN sample_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM l WHERE p <> ''""",
)
def replicons(spark, folder):
    """Accessions parsed from replicon texts composed of the listed plasmids, with and without the second part."""
    listed = table(spark, folder, "samples").select("sample_id", F.explode(F.transform(F.split("plasmids", ","), lambda p: F.trim(p))).alias("p")).filter("p <> ''")
    text = F.concat(F.lit("plasmid:"), F.col("p"), F.lit("/"), F.when(F.col("sample_id") % 2 == 0, F.substring("p", 4, 99)).otherwise(""))
    return listed.select(
        "sample_id", S.replicon_accessions(text).alias("refseq"), S.replicon_accessions(text, "genbank").alias("genbank"), F.size(S.replicon_accessions(text, "both")).alias("n")
    )


@query("released_before", "SELECT ref_no FROM df_references WHERE release_date < '2022-06-15'")
def released_before(spark, folder):
    return table(spark, folder, "df_references").filter("release_date < '2022-06-15'").select("ref_no")


@query(
    "unlisted_references",
    f"WITH {CONTIGS}, l AS (SELECT DISTINCT trim(unnest(string_split(plasmids, ','))) AS p FROM samples) SELECT contig FROM ct WHERE contig NOT IN (SELECT p FROM l WHERE p IS NOT NULL)",
)
def unlisted_references(spark, folder):
    """References that no sample lists."""
    listed = table(spark, folder, "samples").select(F.explode(F.transform(F.split("plasmids", ","), lambda p: F.trim(p))).alias("contig"))
    return contig_lengths(spark, folder).join(listed, "contig", "left_anti").select("contig")


@query("dereplicated_references", f"WITH {REFS} SELECT min(ref_no) AS ref_no, s FROM rf GROUP BY s")
def dereplicated_references(spark, folder):
    return R.dereplicated(references(spark, folder), "s", "ref_no")


@query(
    "strandless_groups",
    f"WITH {REFS}, k AS (SELECT ref_no, least(s, {RC.format('s')}) AS c FROM rf), g AS (SELECT c, min(ref_no) AS representative, count(*) AS size FROM k GROUP BY 1 HAVING count(*) > 1) SELECT ref_no, representative, size FROM k JOIN g USING (c)",
)
def strandless_groups(spark, folder):
    return R.identical_groups(references(spark, folder), "ref_no", "s")


@query(
    "near_identical",
    f"WITH {CONTIGS} SELECT DISTINCT qseqid, sseqid FROM matches m JOIN ct a ON a.contig = qseqid JOIN ct b ON b.contig = sseqid WHERE qseqid < sseqid AND pident >= 90 AND m.length >= 0.5 * a.length AND m.length >= 0.5 * b.length",
)
def near_identical(spark, folder):
    return R.symmetric_pairs(table(spark, folder, "matches"), contig_lengths(spark, folder), identity=90.0, share=0.5)


@query(
    "differing_hits",
    f"WITH {CONTIGS} SELECT hit_id FROM matches m JOIN ct a ON a.contig = qseqid JOIN ct b ON b.contig = sseqid WHERE pident < 100 OR m.length <> a.length OR m.length <> b.length OR mismatch > 0 OR gapopen > 0",
)
def differing_hits(spark, folder):
    return R.not_identical(table(spark, folder, "matches"), contig_lengths(spark, folder)).select("hit_id")


@query(
    "reference_set_sizes",
    """WITH x AS (SELECT DISTINCT qseqid AS k FROM matches), y AS (SELECT DISTINCT sseqid AS k FROM matches)
SELECT (SELECT count(*) FROM (SELECT k FROM x UNION SELECT k FROM y)) AS either, (SELECT count(*) FROM (SELECT k FROM x INTERSECT SELECT k FROM y)) AS both, (SELECT count(*) FROM (SELECT k FROM x EXCEPT SELECT k FROM y)) AS only_first""",
)
def reference_set_sizes(spark, folder):
    hits = table(spark, folder, "matches")
    return R.set_sizes(hits.select(F.col("qseqid").alias("k")), hits.select(F.col("sseqid").alias("k")), "k")


def database_parts(spark, folder):
    """Plasmids, their stretches of 300 letters taken for genes, and the listed ones as a blacklist."""
    rows = references(spark, folder).withColumn("accession", S.accession_in("id")).filter("accession is not null").withColumn("plasmid", F.lpad(F.col("ref_no").cast("string"), 12, "0"))
    listed = table(spark, folder, "samples").select(F.explode(F.transform(F.split("plasmids", ","), lambda p: F.trim(p))).alias("accession"))
    black = rows.join(listed, "accession", "left_semi").select("plasmid")
    cut = rows.select("plasmid", "s", F.posexplode(F.sequence(F.lit(1), F.length("s"), F.lit(300))).alias("i", "at"))
    stretches = cut.select("plasmid", (F.col("i") + 1).alias("gene_no"), F.expr("substring(s, at, 300)").alias("seq"))
    return rows.select("plasmid", F.length("s").alias("length"), "release_date"), stretches, black


RULES = {"released_before": "2023-06-01", "plasmid_range": (500, 5000), "min_gene": 100}


@query(
    "gene_database",
    f"""WITH {REFS}, {CONTIGS}, l AS (SELECT DISTINCT trim(unnest(string_split(plasmids, ','))) AS p FROM samples),
p AS (SELECT ref_no, s, release_date, CASE WHEN regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') THEN {ACC} END AS a FROM rf WHERE length(s) BETWEEN 500 AND 5000 AND release_date < '2023-06-01'),
g AS (SELECT ref_no, CAST(n AS INTEGER) AS gene_no, substr(s, CAST((n - 1) * 300 + 1 AS BIGINT), 300) AS seq FROM p, LATERAL (SELECT unnest(generate_series(1, CAST(ceil(length(s) / 300.0) AS BIGINT))) AS n) WHERE a IS NOT NULL AND a NOT IN (SELECT p FROM l WHERE p IS NOT NULL))
SELECT plasmid, gene_no, seq FROM (SELECT lpad(CAST(ref_no AS VARCHAR), 12, '0') AS plasmid, gene_no, seq, row_number() OVER (PARTITION BY seq ORDER BY ref_no, gene_no) AS k FROM g WHERE length(seq) >= 100) WHERE k = 1""",
)
def gene_database(spark, folder):
    """A database of stretches of 300 letters of references that qualify and that no sample lists."""
    return R.database(*database_parts(spark, folder), **RULES)


@query(
    "database_counts",
    f"""WITH {REFS}, l AS (SELECT DISTINCT trim(unnest(string_split(plasmids, ','))) AS p FROM samples),
a AS (SELECT ref_no, s, length(s) AS n, release_date, {ACC} IN (SELECT p FROM l WHERE p IS NOT NULL) AS black, length(s) BETWEEN 500 AND 5000 AS fits, coalesce(release_date < '2023-06-01', false) AS early FROM rf WHERE regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+')),
g AS (SELECT black, fits, early, substr(s, CAST((i - 1) * 300 + 1 AS BIGINT), 300) AS seq FROM a, LATERAL (SELECT unnest(generate_series(1, CAST(ceil(n / 300.0) AS BIGINT))) AS i))
SELECT count(*) AS plasmids, count(*) FILTER (black) AS blacklisted, count(*) FILTER (NOT black AND NOT fits) AS wrong_length, count(*) FILTER (NOT black AND fits AND NOT early) AS late, count(*) FILTER (NOT black AND fits AND early) AS used,
  (SELECT count(*) FROM g) AS genes, (SELECT count(*) FROM g WHERE length(seq) < 100) AS short_genes, (SELECT count(DISTINCT seq) FROM g WHERE NOT black AND fits AND early AND length(seq) >= 100) AS genes_used FROM a""",
)
def database_counts(spark, folder):
    """What was read, discarded and used for the database."""
    return R.database_counts(*database_parts(spark, folder), gene_database(spark, folder), **RULES)


@query(
    "suffix_prefix_overlaps",
    f"WITH {REFS} SELECT ref_no, CAST(coalesce((SELECT max(i) FROM (SELECT unnest(generate_series(1, length(s) - 1)) AS i) WHERE left(s, i) = right(s, i)), 0) AS INTEGER) AS overlap FROM rf",
)
def suffix_prefix_overlaps(spark, folder):
    return references(spark, folder).select("ref_no", S.suffix_prefix_overlap("s").alias("overlap"))


@query("translocations", f"WITH {TRANS} SELECT contig, length, partner, round(matched, 9) AS matched, round(translocated, 9) AS translocated, round(unaligned, 9) AS unaligned FROM tl")
def translocations(spark, folder):
    return rounded(reference_translocations(spark, folder), "matched", "translocated", "unaligned")


@query(
    "translocation_totals",
    f"""WITH {TRANS}, tt AS (SELECT tool, tl.* FROM (SELECT DISTINCT tool, plasmid_id FROM eval_refs) JOIN tl ON contig = plasmid_id)
SELECT tool, count(*) FILTER (matched > 0) AS n_matched, round(count(*) FILTER (matched > 0 AND translocated > 0) / nullif(count(*) FILTER (matched > 0), 0), 9) AS translocated_records,
round(sum(matched * length) / sum(length), 9) AS matched, round(sum(translocated * length) / sum(length), 9) AS translocated, round(sum(unaligned * length) / sum(length), 9) AS unaligned FROM tt GROUP BY 1""",
)
def translocation_totals(spark, folder):
    tools = table(spark, folder, "eval_refs").select("tool", F.col("plasmid_id").alias("contig")).distinct()
    found = reference_translocations(spark, folder).join(tools, "contig")
    return rounded(E.translocation_totals(found, ["tool"]), "translocated_records", "matched", "translocated", "unaligned")


#: Binning factors: contigs of a sample are one bin if their GC falls into the same class of so many hundredths; 0 keeps each alone.
FACTORS = (0, 2, 10)
BIN_KEYS = f"""gcs AS (SELECT contig, sample_id, gc FROM (SELECT {{acc}} AS contig, min(sample_id) AS sample_id, max((length(seq) - length(regexp_replace(seq, '[GgCc]', '', 'g'))) / length(seq)) AS gc
  FROM df_references WHERE regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') AND length(seq) > 0 GROUP BY 1) WHERE contig IN (SELECT contig FROM ct)),
bn AS (SELECT contig, factor, CASE WHEN factor = 0 OR sample_id IS NULL THEN contig ELSE 'bin_' || sample_id || '_' || CAST(floor(gc * 100 / factor) AS BIGINT) END AS bin FROM gcs, (VALUES (0), (2), (10)) f(factor))"""


def bin_members(spark, folder):
    """(contig, factor, bin): received sequences of a sample by classes of GC."""
    rows = table(spark, folder, "df_references").select(S.accession_in("id").alias("contig"), "sample_id", "seq").filter("contig is not null and length(seq) > 0")
    facts = rows.groupBy("contig").agg(F.min("sample_id").alias("sample_id"), F.max(S.gc_fraction("seq")).alias("gc")).join(contig_lengths(spark, folder), "contig", "left_semi")
    facts = facts.select("contig", "sample_id", "gc", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor"))
    cls = F.floor(F.try_divide(F.col("gc") * 100, F.col("factor"))).cast("bigint").cast("string")
    return facts.select("contig", "factor", F.coalesce(F.concat(F.lit("bin_"), F.col("sample_id").cast("string"), F.lit("_"), cls), F.col("contig")).alias("bin"))


def binned_translocations(spark, folder):
    """(factor, contig, ...): each record against the bins of its partners, its own hits left out."""
    hits = table(spark, folder, "matches").join(table(spark, folder, "genes").select(F.col("gene_id").alias("qseqid")), "qseqid", "left_anti").filter("qseqid <> sseqid")
    lengths = contig_lengths(spark, folder).withColumn("factor", F.explode(F.array(*map(F.lit, FACTORS))))
    return E.translocations(E.binned(hits.select("qseqid", "sseqid", "qstart", "qend"), bin_members(spark, folder)), lengths, by=["factor"])


BINNED = f"""{CONTIGS}, {BIN_KEYS.format(acc=ACC)},
mb AS (SELECT factor, qseqid, bin AS sseqid, qstart, qend FROM matches m JOIN bn ON bn.contig = m.sseqid WHERE qseqid <> m.sseqid AND qseqid <> bin AND qseqid NOT IN (SELECT gene_id FROM genes)),
pp AS (WITH {covered_sql('mb', 'factor, qseqid, sseqid', 'qstart', 'qend')} SELECT * FROM cov), aa AS (WITH {covered_sql('mb', 'factor, qseqid', 'qstart', 'qend')} SELECT factor, qseqid, covered AS any_covered FROM cov),
bb AS (SELECT factor, qseqid, sseqid AS partner, covered FROM (SELECT *, row_number() OVER (PARTITION BY factor, qseqid ORDER BY covered DESC, sseqid) AS k FROM pp) WHERE k = 1),
tb AS (SELECT f.factor, contig, length, partner, least(coalesce(covered, 0), length) / length AS matched, (least(coalesce(any_covered, 0), length) - least(coalesce(covered, 0), length)) / length AS translocated,
  (length - least(coalesce(any_covered, 0), length)) / length AS unaligned FROM ct CROSS JOIN (VALUES (0), (2), (10)) f(factor)
  LEFT JOIN bb ON bb.qseqid = contig AND bb.factor = f.factor LEFT JOIN aa ON aa.qseqid = contig AND aa.factor = f.factor)"""


@query("bin_translocations", f"WITH {BINNED} SELECT factor, contig, length, partner, round(matched, 9) AS matched, round(translocated, 9) AS translocated, round(unaligned, 9) AS unaligned FROM tb")
def bin_translocations(spark, folder):
    return rounded(binned_translocations(spark, folder), "matched", "translocated", "unaligned")


def factor_totals_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, sum(matched * length) / sum(length) AS m, sum(translocated * length) / sum(length) AS t FROM {source} GROUP BY {keys}"""


@query(
    "bin_scores",
    f"""WITH {BINNED}, rt AS ({factor_totals_sql('factor', 'tb')}), tp AS (SELECT factor, tb.* EXCLUDE (factor) FROM tb WHERE contig IN (SELECT plasmid_id FROM eval_refs)), pt AS ({factor_totals_sql('factor', 'tp')})
SELECT factor, evaluation, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1
FROM (SELECT rt.factor, e.evaluation, e.p, e.r FROM rt JOIN pt USING (factor), LATERAL (SELECT 'best' AS evaluation, pt.m AS p, rt.m AS r UNION ALL SELECT 'union', pt.m + pt.t, rt.m + rt.t) e)""",
)
def bin_scores(spark, folder):
    """Best and union scores for each binning factor, from the totals of all records and of those that a tool scores."""
    found = binned_translocations(spark, folder)
    scored = found.join(table(spark, folder, "eval_refs").select(F.col("plasmid_id").alias("contig")).distinct(), "contig", "left_semi")
    return rounded(E.scores_from_totals(E.translocation_totals(found, ["factor"]), E.translocation_totals(scored, ["factor"]), ["factor"]), "precision", "recall", "f1")


@query(
    "level_scores",
    """WITH o AS (SELECT tool, length, length * coalesce(union_recall, 0) AS lr, row_number() OVER w AS level, count(*) OVER (PARTITION BY tool) AS n, sum(length * coalesce(union_recall, 0)) OVER w AS r, sum(length) OVER w AS l
  FROM eval_refs WINDOW w AS (PARTITION BY tool ORDER BY plasmid_id, sample_id, length, union_recall, best_recall NULLS FIRST, scored_at NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT tool, CAST(level AS INTEGER) AS level, CASE WHEN level = n THEN 1 ELSE 3 END AS repetitions, round(r / l, 9) AS recall FROM o WHERE level % 20 = 0 OR level = n
UNION ALL SELECT DISTINCT tool, 0, 1, 0.0 FROM eval_refs""",
)
def level_scores(spark, folder):
    """Recall over a growing number of a tool's references, in steps of 20."""
    return rounded(E.level_scores(table(spark, folder, "eval_refs"), ["plasmid_id", "sample_id", "length", "union_recall", "best_recall", "scored_at"]), "recall")


@query(
    "plasmid_alignments",
    f"""WITH {CONTIGS}, sm AS (SELECT {ACC} AS contig, min(sample_id) AS sample_id FROM df_references WHERE regexp_matches(id, '(?i)NZ[^A-Za-z0-9]?PL[0-9]+\\.[0-9]+') GROUP BY 1),
cs AS (SELECT contig, ct.length, sample_id FROM ct JOIN sm USING (contig) WHERE sample_id IS NOT NULL), mean AS (SELECT sample_id, avg(length) AS mean_length FROM cs GROUP BY 1),
big AS (SELECT a.sample_id, max(m.length) AS largest FROM matches m JOIN cs a ON a.contig = qseqid JOIN cs b ON b.contig = sseqid WHERE a.sample_id <> b.sample_id GROUP BY 1)
SELECT sample_id, round(mean_length, 6) AS mean_length, coalesce(largest, 0) AS largest, round(coalesce(largest, 0) / mean_length, 9) AS share FROM mean LEFT JOIN big USING (sample_id)""",
)
def plasmid_alignments(spark, folder):
    """Per sample: the largest alignment of its references with those of other samples, against their mean length."""
    rows = table(spark, folder, "df_references").select(S.accession_in("id").alias("contig"), "sample_id").filter("contig is not null")
    of = contig_lengths(spark, folder).join(rows.groupBy("contig").agg(F.min("sample_id").alias("sample_id")), "contig").filter("sample_id is not null")
    return rounded(E.largest_alignments(table(spark, folder, "matches"), of), "mean_length", "share").withColumn("mean_length", F.round("mean_length", 6))


@query(
    "species_databases",
    f"""WITH {SPECIES}, n AS (SELECT species, count(*) AS n_database FROM df_references JOIN sp USING (sample_id) WHERE release_date < '2022-06-15' GROUP BY 1),
r AS (SELECT species, tool, sum(length * coalesce(union_recall, 0)) / sum(length) AS recall FROM eval_refs JOIN sp USING (sample_id) GROUP BY 1, 2)
SELECT species, tool, coalesce(n_database, 0) AS n_database, round(recall, 9) AS recall FROM r LEFT JOIN n USING (species)""",
)
def species_databases(spark, folder):
    """Each species' number of references released in time, 0 if none, beside each tool's recall on it."""
    names = table(spark, folder, "samples").filter("organism is not null").select("sample_id", S.species(F.lower("organism")).alias("species"))
    n = table(spark, folder, "df_references").filter("release_date < '2022-06-15'").join(names, "sample_id").groupBy("species").agg(F.count("*").alias("n_database"))
    recall = (F.sum(F.col("length") * F.coalesce("union_recall", F.lit(0.0))) / F.sum("length")).alias("recall")
    found = table(spark, folder, "eval_refs").join(names, "sample_id").groupBy("species", "tool").agg(recall).join(n, "species", "left")
    return rounded(found.select("species", "tool", F.coalesce("n_database", F.lit(0)).alias("n_database"), "recall"), "recall")


@query(
    "covered_length_shares",
    """WITH e AS (SELECT tool, plasmid_id, max(length) AS length, max(coalesce(best_recall, 0)) AS best FROM eval_refs GROUP BY 1, 2)
SELECT tool, round(sum(CASE WHEN best >= 0.9 THEN length ELSE 0 END) / sum(length), 9) AS share FROM e GROUP BY 1""",
)
def covered_length_shares(spark, folder):
    return rounded(E.covered_length(table(spark, folder, "eval_refs")), "share")


@query("good_ratios", "SELECT tool, count(*) AS n, count(*) FILTER (union_recall >= 0.9) AS n_part, round(count(*) FILTER (union_recall >= 0.9) / count(*), 9) AS ratio FROM eval_refs GROUP BY 1")
def good_ratios(spark, folder):
    return rounded(E.count_ratios(table(spark, folder, "eval_refs"), F.col("union_recall") >= 0.9), "ratio")


@query(
    "threshold_sweep",
    "SELECT run, tool, count(*) FILTER (coalesce(best_recall, 0) >= t) AS n_best FROM eval_refs, (VALUES ('low', 0.5), ('middle', 0.8), ('high', 0.95)) v(run, t) GROUP BY 1, 2",
)
def threshold_sweep(spark, folder):
    """Well found references under three thresholds."""
    refs = table(spark, folder, "eval_refs")
    return E.sweep_table({name: E.one_way(refs, t) for name, t in (("low", 0.5), ("middle", 0.8), ("high", 0.95))}, ["tool"], ["n_best"])


@query(
    "sampling_levels",
    """WITH n AS (SELECT tool, CAST(count(*) AS INTEGER) AS n FROM eval_refs GROUP BY 1), l AS (SELECT tool, n, unnest(list_distinct(list_concat(generate_series(0, n, 20), [n]))) AS level FROM n)
SELECT tool, CAST(level AS INTEGER) AS level, CASE WHEN level = 0 OR level = n THEN 1 ELSE 3 END AS repetitions FROM l""",
)
def sampling_levels(spark, folder):
    """Steps of 20 from none to all records of a tool; only the levels between are repeated."""
    return level_scores(spark, folder).select("tool", "level", "repetitions")


LISTED = "CASE WHEN s.plasmids IS NULL OR trim(s.plasmids) = '' THEN 'unlisted' ELSE 'listed' END"


def listed_group(spark, folder, rows):
    """Rows with ``grp``: whether their sample lists any plasmids."""
    grp = F.when(F.coalesce(F.trim("plasmids"), F.lit("")) == "", "unlisted").otherwise("listed")
    return rows.join(table(spark, folder, "samples").select("sample_id", grp.alias("grp")), "sample_id")


@query(
    "reference_lengths",
    f"""SELECT {LISTED} AS grp, round(avg(length), 6) AS mean, round(quantile_cont(CAST(length AS DOUBLE), 0.75), 6) AS q75, max(length) AS maximum
FROM eval_refs JOIN samples s USING (sample_id) GROUP BY 1""",
)
def reference_lengths(spark, folder):
    found = W.distribution(listed_group(spark, folder, table(spark, folder, "eval_refs")), ["grp"], "length")
    return found.select("grp", F.round("mean", 6).alias("mean"), F.round("q75", 6).alias("q75"), "maximum")


@query(
    "genome_similarity",
    f"""WITH pa AS ({SQL["plasmid_alignments"]})
SELECT {LISTED} AS grp, min(largest) AS minimum, round(avg(largest), 6) AS mean, round(quantile_cont(CAST(largest AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(largest AS DOUBLE), 0.75), 6) AS q75, max(largest) AS maximum
FROM pa JOIN samples s USING (sample_id) GROUP BY 1""",
)
def genome_similarity(spark, folder):
    """How long the largest alignments with other samples are, for samples that list plasmids and for the others."""
    found = W.distribution(listed_group(spark, folder, plasmid_alignments(spark, folder)), ["grp"], "largest")
    return found.select("grp", "minimum", *[F.round(c, 6).alias(c) for c in ("mean", "median", "q75")], "maximum")


@query(
    "scored_samples",
    f"WITH {PREDS}, s AS ({scores_sql('tool, sample_id')}) SELECT tool, sample_id, f1 FROM s WHERE evaluation = 'union' AND (tool, sample_id) IN (SELECT (tool, sample_id) FROM pd) AND sample_id IN (SELECT sample_id FROM samples WHERE trim(coalesce(plasmids, '')) <> '')",
)
def scored_samples(spark, folder):
    """Union scores of the tools that predict anything, for the samples that list plasmids, in the order of the samples."""
    listed = listed_group(spark, folder, sample_scores(spark, folder)).filter("grp = 'listed' and evaluation = 'union'")
    there = predictions(spark, folder).select("tool", "sample_id").distinct()
    return listed.join(there, ["tool", "sample_id"], "left_semi").select("tool", "sample_id", "f1").orderBy("sample_id", "tool")


@query(
    "tabled_accessions",
    """WITH l AS (SELECT sample_id, trim(unnest(string_split(plasmids, ','))) AS p FROM samples WHERE collected_at < TIMESTAMP '2022-01-01')
SELECT DISTINCT string_split(p, '.')[1] AS accession FROM l WHERE p <> '' UNION SELECT DISTINCT string_split(substr(p, 4), '.')[1] FROM l WHERE p <> '' AND length(p) > 3""",
)
def tabled_accessions(spark, folder):
    """Accessions of a table of plasmids composed of the samples: either source, released in time."""
    listed = F.filter(F.transform(F.split("plasmids", ","), lambda p: F.trim(p)), lambda p: p != "")
    text = F.array_join(F.transform(listed, lambda p: F.concat(F.lit("plasmid:"), p, F.lit("/"), F.substring(p, 4, 99))), "; ")
    rows = table(spark, folder, "samples").select(text.alias("Replicons"), F.date_format("collected_at", "yyyy-MM-dd").alias("Release Date"))
    return R.tabled(rows, released_before="2022-01-01")
