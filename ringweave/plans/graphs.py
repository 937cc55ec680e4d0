"""Queries on assembly graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave.functions.sequences import extension_score, overlap_length, reverse_complement
from ringweave.operators import graph as G
from ringweave.operators import weighted as W
from ringweave.plans.catalog import query
from ringweave.plans.hits import CONTIGS, GENE_HITS, contig_lengths, covered_sql, gene_hits
from ringweave.plans.tables import table

NORMAL = """ns AS (SELECT sample_id, seg_name, seq, len AS length, kmer_count, coalesce(depth, kmer_count / nullif(len, 0)) AS depth,
  CASE WHEN length(seq) > 0 THEN (length(seq) - length(regexp_replace(seq, '[GgCc]', '', 'g'))) / length(seq) ELSE 0.0 END AS gc
  FROM (SELECT *, coalesce(length, CASE WHEN seq <> '*' THEN CAST(length(seq) AS INTEGER) END) AS len FROM segments))"""
DEGREES = """dg AS (SELECT s.sample_id, s.seg_name, coalesce(n, 0) AS degree FROM segments s LEFT JOIN (
  SELECT sample_id, seg, count(*) AS n FROM (SELECT sample_id, from_seg AS seg FROM links UNION ALL SELECT sample_id, to_seg FROM links) GROUP BY ALL) e
  ON e.sample_id = s.sample_id AND e.seg = s.seg_name)"""
COMPONENTS = """nb AS (SELECT DISTINCT sample_id, from_seg AS a, to_seg AS b FROM links UNION SELECT DISTINCT sample_id, to_seg, from_seg FROM links),
rc(sample_id, seg_name, other) AS (SELECT sample_id, seg_name, seg_name FROM segments UNION SELECT rc.sample_id, rc.seg_name, nb.b FROM rc JOIN nb ON nb.sample_id = rc.sample_id AND nb.a = rc.other),
cp AS (SELECT sample_id, seg_name, min(other) AS component FROM rc GROUP BY 1, 2)"""


def graph(spark, folder):
    return table(spark, folder, "segments"), table(spark, folder, "links")


@query("segment_facts", f"WITH {NORMAL} SELECT sample_id, seg_name, length, round(depth, 6) AS depth, round(gc, 6) AS gc FROM ns")
def segment_facts(spark, folder):
    return G.normal_segments(table(spark, folder, "segments")).select("sample_id", "seg_name", "length", F.round("depth", 6).alias("depth"), F.round("gc", 6).alias("gc"))


@query(
    "reverse_complements",
    "SELECT sample_id, seg_name, reverse(translate(seq, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) AS rc FROM segments WHERE seq <> '*'",
)
def reverse_complements(spark, folder):
    return table(spark, folder, "segments").filter("seq <> '*'").select("sample_id", "seg_name", reverse_complement("seq").alias("rc"))


@query("overlap_lengths", "SELECT sample_id, from_seg, to_seg, overlap, coalesce(TRY_CAST(left(overlap, length(overlap) - 1) AS INTEGER), 0) AS overlap_length FROM links")
def overlap_lengths(spark, folder):
    return table(spark, folder, "links").select("sample_id", "from_seg", "to_seg", "overlap", overlap_length("overlap").alias("overlap_length"))


@query(
    "oriented_edges",
    """WITH l AS (SELECT *, coalesce(TRY_CAST(left(overlap, length(overlap) - 1) AS INTEGER), 0) AS n FROM links)
SELECT sample_id, from_seg AS src, from_ori AS src_ori, to_seg AS dst, to_ori AS dst_ori, n AS overlap FROM l
UNION ALL SELECT sample_id, to_seg, CASE WHEN to_ori = '+' THEN '-' ELSE '+' END, from_seg, CASE WHEN from_ori = '+' THEN '-' ELSE '+' END, n FROM l""",
)
def oriented_edges(spark, folder):
    return G.edges(table(spark, folder, "links"))


@query("neighbours", "SELECT DISTINCT sample_id, from_seg AS src, to_seg AS dst FROM links UNION SELECT DISTINCT sample_id, to_seg, from_seg FROM links")
def neighbours(spark, folder):
    return G.neighbours(table(spark, folder, "links"))


@query("segment_degrees", f"WITH {DEGREES} SELECT sample_id, seg_name, degree FROM dg")
def segment_degrees(spark, folder):
    return G.degrees(*graph(spark, folder))


@query("graph_components", f"WITH RECURSIVE {COMPONENTS} SELECT * FROM cp")
def graph_components(spark, folder):
    return G.components(*graph(spark, folder))


DEEP = "SELECT sample_id, seg_name FROM segments WHERE depth >= 0.8"


@query("deep_components", f"WITH RECURSIVE {COMPONENTS.replace('FROM segments', 'FROM sub').replace('FROM links', 'FROM li').replace('nb AS', f'sub AS ({DEEP}), li AS (SELECT * FROM links l WHERE EXISTS (SELECT 1 FROM sub WHERE sub.sample_id = l.sample_id AND seg_name = from_seg) AND EXISTS (SELECT 1 FROM sub WHERE sub.sample_id = l.sample_id AND seg_name = to_seg)), nb AS', 1)} SELECT * FROM cp")
def deep_components(spark, folder):
    """Components of the subgraph of deep segments."""
    segments, links = graph(spark, folder)
    return G.components(segments, links, segments.filter("depth >= 0.8"))


@query(
    "graph_statistics",
    f"""WITH RECURSIVE {NORMAL}, {DEGREES}, {COMPONENTS},
ps AS (SELECT sample_id, seg_name, coalesce(length, 0) AS length, degree, component FROM ns JOIN dg USING (sample_id, seg_name) JOIN cp USING (sample_id, seg_name)),
b AS (SELECT sample_id, avg(degree) AS mean_degree, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median_degree, avg(length) AS mean_length, quantile_cont(CAST(length AS DOUBLE), 0.5) AS median_length,
  count(*) FILTER (degree = 1) AS dead_ends, count(*) FILTER (degree = 1) / nullif(count(*) FILTER (degree > 0), 0) AS dead_end_share FROM ps GROUP BY 1),
z AS (SELECT sample_id, component, CAST(sum(length) AS BIGINT) AS nt, count(*) AS n FROM ps GROUP BY 1, 2),
c AS (SELECT sample_id, count(*) AS n_components, sum(nt) / count(*) AS mean_component_nt, quantile_cont(CAST(nt AS DOUBLE), 0.5) AS median_component_nt, sum(n) / count(*) AS mean_component_segments,
  quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_component_segments FROM z GROUP BY 1),
r AS (SELECT sample_id, length, sum(length) OVER (PARTITION BY sample_id ORDER BY length) AS upto, sum(length) OVER (PARTITION BY sample_id) AS total FROM ps),
h AS (SELECT sample_id, min(length) AS n50 FROM r WHERE upto >= total / 2 GROUP BY 1)
SELECT * FROM b JOIN c USING (sample_id) LEFT JOIN h USING (sample_id)""",
)
def graph_statistics(spark, folder):
    return G.graph_statistics(*graph(spark, folder))


@query(
    "component_representatives",
    f"""WITH RECURSIVE {NORMAL}, {COMPONENTS}
SELECT sample_id, component, seg_name FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, component ORDER BY coalesce(length, 0) DESC, seg_name) AS n FROM ns JOIN cp USING (sample_id, seg_name)) WHERE n = 1""",
)
def component_representatives(spark, folder):
    return G.representatives(*graph(spark, folder))


@query(
    "weighted_means",
    f"""WITH {NORMAL} SELECT sample_id, round(sum(depth * length) / CASE WHEN sum(length) > 0 THEN sum(length) ELSE 1 END, 6) AS mean_depth,
  round(sum(gc * length) / CASE WHEN sum(length) > 0 THEN sum(length) ELSE 1 END, 6) AS gc FROM ns WHERE depth IS NOT NULL AND length IS NOT NULL GROUP BY 1""",
)
def weighted_means(spark, folder):
    known = G.normal_segments(table(spark, folder, "segments")).filter("depth is not null and length is not null")
    return known.groupBy("sample_id").agg(F.round(W.mean_of("depth", "length"), 6).alias("mean_depth"), F.round(W.mean_of("gc", "length"), 6).alias("gc"))


MEDIAN = """mk AS (SELECT * FROM ns WHERE depth IS NOT NULL AND length IS NOT NULL),
mt AS (SELECT sample_id, depth, sum(length) OVER (PARTITION BY sample_id ORDER BY depth) AS upto, sum(length) OVER (PARTITION BY sample_id) AS total FROM mk),
ml AS (SELECT sample_id, min(depth) FILTER (upto >= floor(total / 2)) AS lo, min(depth) FILTER (upto >= floor(total / 2) + 1) AS hi, max(total / 2 - floor(total / 2)) AS part FROM mt GROUP BY 1),
md AS (SELECT sample_id, lo + (coalesce(hi, lo) - lo) * part AS median_depth FROM ml)"""


@query("weighted_medians", f"WITH {NORMAL}, {MEDIAN} SELECT sample_id, round(median_depth, 6) AS median_depth FROM md")
def weighted_medians(spark, folder):
    found = W.weighted_median(G.normal_segments(table(spark, folder, "segments")), ["sample_id"], "depth", "length", "median_depth")
    return found.select("sample_id", F.round("median_depth", 6).alias("median_depth"))


@query(
    "depth_thresholds",
    f"WITH {NORMAL}, {MEDIAN} SELECT sample_id, round(0.4 * median_depth, 6) AS min_plasmid_depth, round(0.3 * median_depth, 6) AS min_contig_depth FROM md",
)
def depth_thresholds(spark, folder):
    """Depths below which a plasmid, and a contig, is not considered: shares of the weighted median."""
    found = W.weighted_median(G.normal_segments(table(spark, folder, "segments")), ["sample_id"], "depth", "length", "m")
    return found.select("sample_id", F.round(0.4 * F.col("m"), 6).alias("min_plasmid_depth"), F.round(0.75 * 0.4 * F.col("m"), 6).alias("min_contig_depth"))


@query(
    "weighted_deviations",
    f"""WITH {NORMAL}, k AS (SELECT * FROM ns WHERE depth IS NOT NULL AND length IS NOT NULL), m AS (SELECT sample_id, sum(depth * length) / sum(length) AS dm, sum(gc * length) / sum(length) AS gm FROM k GROUP BY 1)
SELECT sample_id, round(max(dm), 6) AS depth_mean, round(sqrt(sum((depth - dm) ** 2 * length) / sum(length)), 6) AS depth_sd, round(max(gm), 6) AS gc_mean, round(sqrt(sum((gc - gm) ** 2 * length) / sum(length)), 6) AS gc_sd
FROM k JOIN m USING (sample_id) GROUP BY 1""",
)
def weighted_deviations(spark, folder):
    known = G.normal_segments(table(spark, folder, "segments")).filter("depth is not null and length is not null")
    found = W.deviations(known, ["sample_id"], ["depth", "gc"], "length")
    return found.select("sample_id", *[F.round(c, 6).alias(c) for c in ("depth_mean", "depth_sd", "gc_mean", "gc_sd")])


def segment_densities(spark, folder):
    """(sample_id, seg_name, density): segments take the gene density of the reference with their number."""
    covered = gene_hits(spark, folder)
    from ringweave.operators.hits import densities

    dens = densities(covered, contig_lengths(spark, folder)).select("contig", "density")
    name = F.concat(F.lit("NZ_PL"), F.lpad("seg_name", 8, "0"), F.lit(".1"))
    return table(spark, folder, "segments").withColumn("contig", name).join(dens, "contig").select("sample_id", "seg_name", "density")


SEG_DENS = f"""{GENE_HITS}, {CONTIGS}, {covered_sql('gh', 'sseqid', 'sstart', 'send')},
sd AS (SELECT sample_id, seg_name, coalesce(covered, 0) / ct.length AS density FROM segments s JOIN ct ON contig = 'NZ_PL' || lpad(seg_name, 8, '0') || '.1' LEFT JOIN cov ON sseqid = contig)"""


@query(
    "seed_order",
    f"""WITH {NORMAL}, {SEG_DENS},
og AS (SELECT sample_id, sum(gc * length) / CASE WHEN sum(length) > 0 THEN sum(length) ELSE 1 END AS overall FROM ns WHERE length IS NOT NULL GROUP BY 1),
ab AS (SELECT ns.sample_id, ns.seg_name, ns.length, depth, density, gc, abs(gc - overall) AS gd FROM ns JOIN sd USING (sample_id, seg_name) JOIN og USING (sample_id) WHERE depth >= 0.3 AND density >= 0.1 AND ns.length <= 800),
st AS (SELECT sample_id, sum(density * length) / sum(length) AS dm, sum(gd * length) / sum(length) AS gm FROM ab GROUP BY 1),
sp AS (SELECT sample_id, max(dm) AS dm, max(gm) AS gm, sqrt(sum((density - dm) ** 2 * length) / sum(length)) AS ds, sqrt(sum((gd - gm) ** 2 * length) / sum(length)) AS gs FROM ab JOIN st USING (sample_id) GROUP BY 1),
ed AS (SELECT sample_id, from_seg AS src, from_ori AS ori FROM links UNION ALL SELECT sample_id, to_seg, CASE WHEN to_ori = '+' THEN '-' ELSE '+' END FROM links),
wy AS (SELECT sample_id, src AS seg_name, count(*) FILTER (ori = '+') AS o, count(*) FILTER (ori = '-') AS i FROM ed GROUP BY 1, 2),
rk AS (SELECT ab.*, (density - dm) / CASE WHEN ds < 1e-7 THEN 1 ELSE ds END + (gd - gm) / CASE WHEN gs < 1e-7 THEN 1 ELSE gs END AS z, coalesce(o, 0) <= 1 AND coalesce(i, 0) <= 1 AS unambiguous FROM ab JOIN sp USING (sample_id) LEFT JOIN wy USING (sample_id, seg_name))
SELECT sample_id, seg_name, unambiguous, round(z, 4) AS z, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY unambiguous DESC, round(z, 9) DESC, seg_name DESC) AS INTEGER) AS place FROM rk""",
)
def seed_order(spark, folder):
    found = G.seeds(*graph(spark, folder), segment_densities(spark, folder), min_depth=0.3, min_density=0.1, max_length=800)
    return found.select("sample_id", "seg_name", "unambiguous", F.round("z", 4).alias("z"), "place")


@query(
    "extension_scores",
    f"""WITH {NORMAL}, {SEG_DENS}, l AS (SELECT row_number() OVER () AS n, * FROM links)
SELECT l.sample_id, from_seg, to_seg, round(abs(1 - b.depth / a.depth) + 0.5 * (1 - coalesce(density, 0)) + 0.25 * abs(a.gc - b.gc), 6) AS score
FROM l JOIN ns a ON a.sample_id = l.sample_id AND a.seg_name = from_seg JOIN ns b ON b.sample_id = l.sample_id AND b.seg_name = to_seg LEFT JOIN sd ON sd.sample_id = l.sample_id AND sd.seg_name = to_seg
WHERE a.depth > 0 AND b.depth IS NOT NULL""",
)
def extension_scores(spark, folder):
    """Score of continuing each link's first segment by its second."""
    segments, links = graph(spark, folder)
    normal = G.normal_segments(segments)
    ends = [normal.select("sample_id", *[F.col(c).alias(f"{p}_{c}") for c in ("seg_name", "depth", "gc")]) for p in ("a", "b")]
    joined = links.join(ends[0].withColumnRenamed("a_seg_name", "from_seg"), ["sample_id", "from_seg"]).join(ends[1].withColumnRenamed("b_seg_name", "to_seg"), ["sample_id", "to_seg"])
    joined = joined.join(segment_densities(spark, folder).withColumnRenamed("seg_name", "to_seg"), ["sample_id", "to_seg"], "left")
    score = extension_score(F.col("a_depth"), F.col("a_gc"), F.col("b_depth"), F.coalesce("density", F.lit(0.0)), F.col("b_gc"), {"depth_diff": 1.0, "gene_density": 0.5, "gc_diff": 0.25})
    return joined.filter("a_depth > 0 and b_depth is not null").select("sample_id", "from_seg", "to_seg", F.round(score, 6).alias("score"))


@query(
    "graph_against_scores",
    f"""WITH {NORMAL}, {DEGREES},
g AS (SELECT sample_id, avg(degree) AS mean_degree, count(*) FILTER (degree = 1) AS dead_ends FROM dg GROUP BY 1),
r AS (SELECT sample_id, coalesce(length, 0) AS length, sum(coalesce(length, 0)) OVER (PARTITION BY sample_id ORDER BY coalesce(length, 0)) AS upto, sum(coalesce(length, 0)) OVER (PARTITION BY sample_id) AS total FROM ns),
h AS (SELECT sample_id, min(length) AS n50 FROM r WHERE upto >= total / 2 GROUP BY 1),
s AS (SELECT tool, sample_id, sum(length * coalesce(union_recall, 0)) / sum(length) AS recall FROM eval_refs GROUP BY 1, 2)
SELECT tool, sample_id, round(recall, 9) AS recall, mean_degree, dead_ends, n50 FROM s JOIN g USING (sample_id) JOIN h USING (sample_id)""",
)
def graph_against_scores(spark, folder):
    """Characteristics of each sample's graph beside each tool's recall on it."""
    segments, links = graph(spark, folder)
    degree = G.degrees(segments, links).groupBy("sample_id").agg(F.avg("degree").alias("mean_degree"), F.count_if(F.col("degree") == 1).alias("dead_ends"))
    length = G.normal_segments(segments).select("sample_id", F.coalesce("length", F.lit(0)).alias("length"))
    recall = (F.sum(F.col("length") * F.coalesce("union_recall", F.lit(0.0))) / F.sum("length")).alias("recall")
    scores = table(spark, folder, "eval_refs").groupBy("tool", "sample_id").agg(recall)
    joined = scores.join(degree, "sample_id").join(W.n50(length, ["sample_id"], "length"), "sample_id")
    return joined.select("tool", "sample_id", F.round("recall", 9).alias("recall"), "mean_degree", "dead_ends", "n50")
