"""Queries on plasmid candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave.operators import finder as P
from ringweave.operators import graph as G
from ringweave.plans.catalog import SQL, query
from ringweave.plans.files import by_sample
from ringweave.plans.graphs import NORMAL, SEG_DENS, graph, segment_densities
from ringweave.plans.hits import covered_sql, gene_hits
from ringweave.plans.tables import table
from ringweave.session import Scratch
from ringweave.sources import gfa

RULES = P.Growth()


def densities(spark, folder):
    return segment_densities(spark, folder).withColumn("has_genes", F.col("density") > 0)


def members(spark, folder):
    found = P.grow(*graph(spark, folder), densities(spark, folder), RULES)
    return Scratch(spark, "members").write(found, "members")


@query("plasmid_members")
def plasmid_members(spark, folder):
    """No SQL: growth is sequential; tested against a model of its rules, and for the depth it may take."""
    return members(spark, folder).select("sample_id", "plasmid_no", "pos", "seg_name", "orientation", F.round("depth", 6).alias("depth"), "circular")


@query("plasmid_classes")
def plasmid_classes(spark, folder):
    grown = members(spark, folder)
    found = P.facts(grown, *graph(spark, folder), densities(spark, folder))
    return P.classified(found, grown, min_density=0.1, min_depth=0.2, min_length=100, max_length=RULES.max_length).drop("seq")


@query("plasmid_chains")
def plasmid_chains(spark, folder):
    return P.chain_lines(members(spark, folder)).select("sample_id", "value")



@query("plasmid_bins")
def plasmid_bins(spark, folder):
    return P.bins(P.facts(members(spark, folder), *graph(spark, folder), densities(spark, folder)), table(spark, folder, "segments"))


@query("unused_segments")
def unused_segments(spark, folder):
    return P.unused_statistics(table(spark, folder, "segments"), members(spark, folder))


# Candidates that SQL can state: each link from one segment to another is a chain of two.
PAIRS = f"""{NORMAL}, {SEG_DENS}, mb AS (SELECT DISTINCT sample_id, from_seg || from_ori || to_seg || to_ori AS plasmid_no, from_seg, from_ori, to_seg, to_ori FROM links WHERE from_seg <> to_seg),
nl AS (SELECT *, coalesce(TRY_CAST(left(overlap, length(overlap) - 1) AS INTEGER), 0) AS n FROM links),
ed AS (SELECT sample_id, from_seg AS src, from_ori AS src_ori, to_seg AS dst, to_ori AS dst_ori, n FROM nl
  UNION ALL SELECT sample_id, to_seg, CASE WHEN to_ori = '+' THEN '-' ELSE '+' END, from_seg, CASE WHEN from_ori = '+' THEN '-' ELSE '+' END, n FROM nl),
ov AS (SELECT sample_id, src, src_ori, dst, dst_ori, max(n) AS ov FROM ed GROUP BY ALL),
kn AS (SELECT ns.*, coalesce(d.density, 0) AS density, reverse(translate(seq, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) AS back FROM ns LEFT JOIN (SELECT sample_id, seg_name, density FROM sd) d USING (sample_id, seg_name) WHERE depth IS NOT NULL AND length IS NOT NULL),
m2 AS (SELECT mb.*, a.length AS la, b.length AS lb, a.depth AS da, b.depth AS db, a.density AS ga, b.density AS gb, least(coalesce(ov, 0), b.length) AS h, a.seq <> '*' AND b.seq <> '*' AS known,
  substr(CASE WHEN from_ori = '+' THEN a.seq ELSE a.back END, 1, a.length) AS ta, CASE WHEN to_ori = '+' THEN b.seq ELSE b.back END AS tb
  FROM mb JOIN kn a ON a.sample_id = mb.sample_id AND a.seg_name = from_seg JOIN kn b ON b.sample_id = mb.sample_id AND b.seg_name = to_seg
  JOIN ov ON ov.sample_id = mb.sample_id AND src = from_seg AND src_ori = from_ori AND dst = to_seg AND dst_ori = to_ori),
fx AS (SELECT sample_id, plasmid_no, from_seg, to_seg, la + lb - h AS length, (da * la + db * (lb - h)) / greatest(la + lb - h, 1) AS mean_depth, (ga * la + gb * (lb - h)) / greatest(la + lb - h, 1) AS density,
  CASE WHEN known THEN ta || substr(tb, h + 1, lb - h) END AS s FROM m2),
fa AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN length(s) > 0 THEN (length(s) - length(regexp_replace(s, '[GgCc]', '', 'g'))) / length(s) ELSE 0.0 END AS gc FROM fx),
gd AS (SELECT *, density >= 0.05 AND mean_depth >= 0.4 AND length BETWEEN 200 AND 1500 AS good, least(from_seg, to_seg) AS s1, greatest(from_seg, to_seg) AS s2 FROM fa),
cs AS (SELECT gd.*, CASE WHEN good AND plasmid_no = max(plasmid_no) FILTER (good) OVER (PARTITION BY sample_id, s1, s2) THEN 'putative' ELSE 'questionable' END AS class FROM gd)"""


def pairs(spark, folder):
    """Members of the chains that the links state."""
    segments, links = graph(spark, folder)
    chains = links.filter("from_seg <> to_seg").select("sample_id", "from_seg", "from_ori", "to_seg", "to_ori").distinct()
    number = F.concat("from_seg", "from_ori", "to_seg", "to_ori")
    steps = F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"{end}_seg").alias("seg_name"), F.col(f"{end}_ori").alias("orientation")) for i, end in enumerate(("from", "to"))]))
    rows = chains.select("sample_id", number.alias("plasmid_no"), F.col("from_seg").alias("seed"), F.lit(False).alias("circular"), steps)
    known = G.normal_segments(segments).filter("depth is not null and length is not null").select("sample_id", "seg_name", "depth")
    rows = rows.join(known, ["sample_id", "seg_name"])
    whole = rows.groupBy("sample_id", "plasmid_no").count().filter("count = 2").select("sample_id", "plasmid_no")
    return rows.join(whole, ["sample_id", "plasmid_no"], "left_semi")


def pair_facts(spark, folder, chains, **how):
    return P.facts(chains, *graph(spark, folder), densities(spark, folder), **how)


def pair_classes(spark, folder, chains):
    return P.classified(pair_facts(spark, folder, chains), chains, min_density=0.05, min_depth=0.4, min_length=200, max_length=1500)


@query(
    "pair_facts",
    f"WITH {PAIRS} SELECT sample_id, plasmid_no, length, 2 AS n_members, round(mean_depth, 6) AS mean_depth, round(density, 6) AS density, round(gc, 6) AS gc, s AS seq FROM fa",
)
def pair_facts_query(spark, folder):
    """Lengths, depths, densities, GC and sequences of chains, overlaps counted once."""
    found = pair_facts(spark, folder, pairs(spark, folder))
    return found.select("sample_id", "plasmid_no", "length", "n_members", *[F.round(c, 6).alias(c) for c in ("mean_depth", "density", "gc")], "seq")


@query("pair_classes", f"WITH {PAIRS} SELECT sample_id, plasmid_no, class FROM cs")
def pair_classes_query(spark, folder):
    """Putative and questionable chains; of chains with the same segments the last remains."""
    return pair_classes(spark, folder, pairs(spark, folder)).select("sample_id", "plasmid_no", "class")


@query("pair_chains", f"WITH {PAIRS} SELECT sample_id, 'plasmid_' || plasmid_no || ';' || from_seg || from_ori || ',' || to_seg || to_ori AS value FROM m2")
def pair_chains(spark, folder):
    return P.chain_lines(pairs(spark, folder)).select("sample_id", "value")


@query(
    "pair_heads",
    f"""WITH {PAIRS} SELECT sample_id, 'plasmid_' || plasmid_no || ' seed_contig=' || from_seg || chr(9) || 'length=' || length || chr(9) || 'mean_read_depth=' || printf('%.6f', round(mean_depth, 5)) || chr(9) || 'gene_density=' || printf('%.6f', round(density, 5))
  || chr(9) || 'gc_content=' || printf('%.6f', round(gc, 5)) || chr(9) || 'circular=0' AS head, s AS seq FROM fa WHERE s IS NOT NULL""",
)
def pair_heads(spark, folder):
    """Definition lines and sequences; values to five decimals."""
    found = pair_facts(spark, folder, pairs(spark, folder))
    return P.record_heads(found.withColumns({c: F.round(c, 5) for c in ("mean_depth", "density", "gc")})).select("sample_id", "head", "seq")


@query(
    "pair_records",
    f"""WITH {PAIRS} SELECT sample_id, from_seg || '|0_plasmid_' || plasmid_no AS head, CASE WHEN from_ori = '+' THEN a.seq ELSE a.back END AS seq FROM m2 JOIN kn a USING (sample_id) WHERE a.seg_name = from_seg AND a.seq <> '*'
UNION ALL SELECT sample_id, to_seg || '|1_plasmid_' || plasmid_no, CASE WHEN to_ori = '+' THEN b.seq ELSE b.back END FROM m2 JOIN kn b USING (sample_id) WHERE b.seg_name = to_seg AND b.seq <> '*'""",
)
def pair_records(spark, folder):
    """The members' sequences as they lie in their chains."""
    return P.member_records(pairs(spark, folder), table(spark, folder, "segments")).select("sample_id", "head", "seq")


@query(
    "pair_unused",
    f"""WITH {PAIRS}, us AS (SELECT DISTINCT sample_id, unnest([from_seg, to_seg]) AS seg_name FROM m2), re AS (SELECT kn.* FROM kn ANTI JOIN us USING (sample_id, seg_name))
SELECT sample_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS length, round(sum(depth * length) / greatest(sum(length), 1), 6) AS mean_depth, round(sum(gc * length) / greatest(sum(length), 1), 6) AS gc FROM re GROUP BY 1""",
)
def pair_unused(spark, folder):
    """What no chain uses."""
    found = P.unused_statistics(table(spark, folder, "segments"), pairs(spark, folder))
    return found.select("sample_id", "n", "length", F.round("mean_depth", 6).alias("mean_depth"), F.round("gc", 6).alias("gc"))


@query(
    "pair_coverage",
    f"""WITH {PAIRS}, sh AS (SELECT seg.sample_id, seg.seg_name, least(sstart, send) - 1 AS a, greatest(sstart, send) - 1 AS b FROM (SELECT sample_id, seg_name, 'NZ_PL' || lpad(seg_name, 8, '0') || '.1' AS contig FROM segments) seg JOIN gh ON sseqid = contig WHERE sstart IS NOT NULL AND send IS NOT NULL),
ly AS (SELECT m2.sample_id, plasmid_no, la + lb - h AS size, CASE WHEN from_ori = '+' THEN a ELSE la - b - 1 END AS a, CASE WHEN from_ori = '+' THEN b ELSE la - a - 1 END AS b FROM m2 JOIN sh ON sh.sample_id = m2.sample_id AND seg_name = from_seg
  UNION ALL SELECT m2.sample_id, plasmid_no, la + lb - h, la - h + CASE WHEN to_ori = '+' THEN a ELSE lb - b - 1 END, la - h + CASE WHEN to_ori = '+' THEN b ELSE lb - a - 1 END FROM m2 JOIN sh ON sh.sample_id = m2.sample_id AND seg_name = to_seg),
rg AS (SELECT sample_id, plasmid_no, size, CASE WHEN b < size THEN a ELSE a % size END AS a, CASE WHEN b < size THEN b ELSE b % size END AS b, b >= size AND b - a + 1 >= size AS whole FROM ly WHERE size > 0),
pc AS (SELECT sample_id, plasmid_no, 0 AS a, size - 1 AS b FROM rg WHERE whole UNION ALL SELECT sample_id, plasmid_no, a, b FROM rg WHERE NOT whole AND a <= b
  UNION ALL SELECT sample_id, plasmid_no, a, size - 1 FROM rg WHERE NOT whole AND a > b UNION ALL SELECT sample_id, plasmid_no, 0, b FROM rg WHERE NOT whole AND a > b),
ps AS (SELECT sample_id, plasmid_no, greatest(a, 0) AS a, b FROM pc WHERE greatest(a, 0) <= b),
cg AS (WITH {covered_sql('ps', 'sample_id, plasmid_no', 'a', 'b')} SELECT * FROM cov)
SELECT m2.sample_id, m2.plasmid_no, coalesce(covered, 0) AS covered FROM m2 LEFT JOIN cg ON cg.sample_id = m2.sample_id AND cg.plasmid_no = m2.plasmid_no""",
)
def pair_coverage(spark, folder):
    """Positions of each chain that genes cover."""
    return P.chain_coverage(pairs(spark, folder), *graph(spark, folder), segment_hits(spark, folder)).select("sample_id", "plasmid_no", "covered")


def segment_hits(spark, folder):
    """Gene hits on the references with the segments' numbers, as hits on the segments."""
    name = F.concat(F.lit("NZ_PL"), F.lpad("seg_name", 8, "0"), F.lit(".1"))
    return table(spark, folder, "segments").select("sample_id", "seg_name", name.alias("sseqid")).join(gene_hits(spark, folder), "sseqid").select("sample_id", "seg_name", "sstart", "send")


@query(
    "tagged_segments",
    f"""WITH {PAIRS}, lb AS (SELECT sample_id, seg_name, array_to_string(list_sort(list(DISTINCT plasmid_no)), ',') AS ids, bool_or(class = 'putative') AS sure
  FROM (SELECT sample_id, plasmid_no, class, unnest([from_seg, to_seg]) AS seg_name FROM cs) GROUP BY 1, 2), st AS (SELECT DISTINCT sample_id, seg_name FROM sd WHERE density > 0)
SELECT CAST(s.sample_id AS VARCHAR) AS sample_id, s.seg_name, CASE WHEN ids IS NULL THEN NULL ELSE 'LB:z:' || CASE WHEN st.seg_name IS NULL THEN '' ELSE '*' END || ids END AS label, CASE WHEN ids IS NULL THEN NULL WHEN sure THEN 'CL:z:blue' ELSE 'CL:z:lightblue' END AS colour
FROM segments s LEFT JOIN lb ON lb.sample_id = s.sample_id AND lb.seg_name = s.seg_name LEFT JOIN st ON st.sample_id = s.sample_id AND st.seg_name = s.seg_name""",
)
def tagged_segments(spark, folder):
    """Graph files with the chains' labels and colours on their segments."""
    text = lambda df: df.withColumn("sample_id", F.col("sample_id").cast("string"))
    chains = Scratch(spark, "pairs").write(pairs(spark, folder), "pairs")
    lines = by_sample(spark, gfa.segment_lines(table(spark, folder, "segments")))
    tagged = P.tagged_lines(lines, text(chains), text(pair_classes(spark, folder, chains)), text(densities(spark, folder).filter("has_genes")))
    parts = F.split("value", "\t")
    tag = lambda start: F.try_element_at(F.filter(parts, lambda p: p.startswith(start)), F.lit(1))
    return tagged.select("sample_id", parts[1].alias("seg_name"), tag("LB:").alias("label"), tag("CL:").alias("colour"))


@query(
    "seed_weights",
    f"""WITH so AS ({SQL["seed_order"]}), {NORMAL.replace("ns AS", "nx AS")}, sx AS (SELECT so.sample_id, so.seg_name FROM so), {SEG_DENS},
k AS (SELECT nx.sample_id, nx.length, nx.depth, nx.gc, sd.density FROM sx JOIN nx USING (sample_id, seg_name) JOIN sd USING (sample_id, seg_name)),
m AS (SELECT sample_id, sum(depth * length) / sum(length) AS dm, sum(density * length) / sum(length) AS nm, sum(gc * length) / sum(length) AS gm FROM k GROUP BY 1)
SELECT sample_id, round(CASE WHEN count(*) > 1 THEN sqrt(sum((depth - dm) ** 2 * length) / sum(length)) ELSE 0 END, 6) AS depth_diff, round(CASE WHEN count(*) > 1 THEN sqrt(sum((density - nm) ** 2 * length) / sum(length)) ELSE 0 END, 6) AS gene_density,
  round(CASE WHEN count(*) > 1 THEN sqrt(sum((gc - gm) ** 2 * length) / sum(length)) ELSE 0 END, 6) AS gc_diff FROM k JOIN m USING (sample_id) GROUP BY 1""",
)
def seed_weights(spark, folder):
    """Weights of the scores that the seeds' deviations suggest."""
    seeds = G.seeds(*graph(spark, folder), segment_densities(spark, folder), min_depth=0.3, min_density=0.1, max_length=800)
    return P.seed_weights(seeds).select("sample_id", *[F.round(c, 6).alias(c) for c in ("depth_diff", "gene_density", "gc_diff")])


@query(
    "self_overlaps",
    f"""WITH {PAIRS}, z AS (SELECT sample_id, plasmid_no, s, coalesce((SELECT max(i) FROM (SELECT unnest(generate_series(1, length(s) - 1)) AS i) WHERE left(s, i) = right(s, i)), 0) AS same, length FROM fa)
SELECT sample_id, plasmid_no, CASE WHEN same >= 2 THEN length - same ELSE length END AS length, coalesce(same >= 2, false) AS circular FROM z""",
)
def self_overlaps(spark, folder):
    """Chains that end with the letters with which they begin are rings."""
    return pair_facts(spark, folder, pairs(spark, folder), overlap_ends=2).select("sample_id", "plasmid_no", "length", "circular")
