"""Gene-to-contig hit tables (BLAST outfmt 6): filters, classes, densities, fragmented hits.

Hits are rows with ``qseqid`` (gene), ``sseqid`` (contig), ``pident``, ``length``, ``qstart``, ``qend``, ``sstart``,
``send``, and a unique ``hit_id``. A gene may have any share of all hits: what is compared within a gene is first
aggregated by coordinates, of which a gene has no more than its length squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringweave.operators.sweep import periods_and_gaps


def classified(hits: DataFrame, genes: DataFrame, *, identity: float = 0.95, share: float = 0.95) -> DataFrame:
    """Hits with ``verdict``: 'identity' or 'length' for the first test a hit fails, 'kept' otherwise.

    A hit is kept at exactly either threshold. Hits with a null identity or length fail. Genes are joined by id; hits of
    unknown genes are left out (``unknown_genes`` lists them).
    """
    lengths = genes.select(F.col("gene_id").alias("__gene"), F.length("seq").alias("gene_length"))
    joined = hits.join(lengths, F.col("qseqid") == F.col("__gene")).drop("__gene")
    return joined.withColumn(
        "verdict",
        F.when(F.coalesce(F.col("pident"), F.lit(0.0)) < 100 * identity, "identity")
        .when(F.coalesce(F.col("length"), F.lit(0)) / F.col("gene_length") < share, "length").otherwise("kept"),
    )


def unknown_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Queries of the hit table that are no gene of the database."""
    return hits.join(genes, F.col("qseqid") == F.col("gene_id"), "left_anti").select("qseqid").distinct()


def unknown_contigs(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """Subjects of the hit table that are no contig."""
    return hits.join(contigs, F.col("sseqid") == F.col("contig"), "left_anti").select("sseqid").distinct()


def hit_classes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Each gene's number of hits and its class: 'none', 'one' or 'many'."""
    counts = hits.groupBy(F.col("qseqid").alias("gene_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return genes.select("gene_id").join(counts, "gene_id", "left").select("gene_id", n.alias("n_hits"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("hit_class"))


def unlocated(kept: DataFrame, hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes without a kept hit that have some hit."""
    missing = genes.select("gene_id").join(kept, F.col("gene_id") == F.col("qseqid"), "left_anti")
    return missing.join(hits, F.col("gene_id") == F.col("qseqid"), "left_semi")


def covered_bases(hits: DataFrame, key: str, start: str, end: str, name: str = "covered", **how: int) -> DataFrame:
    """key, name: positions that at least one hit covers."""
    found = periods_and_gaps(hits, [key], {"": (start, end)}, **how).filter("kind = 'period'")
    return found.groupBy(key).agg(F.sum(F.col("pos_to") - F.col("pos_from") + 1).alias(name))


def covered_sides(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``q_covered``, ``s_covered``: positions that hits cover on the query and on the subject."""
    found = periods_and_gaps(hits, keys, {"q": ("qstart", "qend"), "s": ("sstart", "send")}).filter("kind = 'period'")
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("pos_to") - F.col("pos_from") + 1)).alias(f"{side}_covered")
    return found.groupBy(*keys).agg(n("q"), n("s"))


def densities(hits: DataFrame, contigs: DataFrame, contig: str = "contig", length: str = "length") -> DataFrame:
    """Per contig: number of hits, of different locations, of genes, covered bases, density and frequency; 0 without hits."""
    counts = hits.groupBy(F.col("sseqid").alias(contig)).agg(
        F.count("*").alias("n_hits"), F.count_distinct("sstart", "send").alias("n_locations"), F.count_distinct("qseqid").alias("n_genes")
    )
    covered = covered_bases(hits, "sseqid", "sstart", "send").withColumnRenamed("sseqid", contig)
    joined = contigs.select(contig, length).join(counts, contig, "left").join(covered, contig, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hits", "n_locations", "n_genes", "covered")]
    joined = joined.select(contig, length, *zero)
    return joined.select(
        "*", F.try_divide(F.col("covered"), F.col(length)).alias("density"), F.try_divide(F.col("n_hits"), F.col(length)).alias("frequency")
    )


def contained(hits: DataFrame) -> DataFrame:
    """Hits whose stretch on the gene lies within that of another hit of the gene; equal stretches contain each other.

    A hit is contained if an earlier start reaches as far as its end, the same start reaches further, or its stretch
    occurs twice. The furthest end by start is a table of at most a gene's length; no pair of hits is formed.
    """
    known = hits.filter("qstart is not null and qend is not null")
    stretch = known.groupBy("qseqid", "qstart", "qend").agg(F.count("*").alias("same"))
    starts = stretch.groupBy("qseqid", "qstart").agg(F.max("qend").alias("furthest"))
    earlier = Window.partitionBy("qseqid").orderBy("qstart").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("reach", F.max("furthest").over(earlier))
    inside = stretch.join(starts, ["qseqid", "qstart"]).filter("reach >= qend or furthest > qend or same > 1").select("qseqid", "qstart", "qend")
    return known.join(inside, ["qseqid", "qstart", "qend"], "left_semi")


def pairwise_overlaps(hits: DataFrame, key: str = "qseqid", start: str = "qstart", end: str = "qend") -> DataFrame:
    """key, ``overlap``: total length of the overlaps of all pairs of hits of a gene.

    A position that n hits cover lies in n (n - 1) / 2 overlaps, so the total is a sweep over positions, not over pairs.
    """
    known = hits.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    events = known.select(
        key, F.inline(F.array(F.struct(F.least(start, end).alias("pos"), F.lit(1).alias("d")), F.struct((F.greatest(start, end) + 1).alias("pos"), F.lit(-1).alias("d"))))
    ).groupBy(key, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("pos")
    cover = events.select(key, F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), (F.lead("pos").over(w) - F.col("pos")).alias("width"))
    return cover.groupBy(key).agg(F.coalesce(F.sum(F.col("width") * F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("overlap"))


def fragmented(hits: DataFrame, genes: DataFrame, *, variant: str = "limited", identity: float = 0.95, share: float = 0.95, overlap: int = 0) -> DataFrame:
    """Hits (by hit_id) of genes that several good hits make up together, though none does alone.

    variant: 'simple' adds all hits' lengths; 'uncontained' those of hits that lie in no other; 'limited' asks that the
    uncontained hits cover the share and that their overlaps add up to no more than ``overlap`` positions.
    """
    lengths = genes.select(F.col("gene_id").alias("qseqid"), F.length("seq").alias("gene_length"))
    good = hits.join(lengths, "qseqid", "left_semi").filter(F.col("pident") >= 100 * identity)
    if variant != "simple":
        good = good.join(contained(good).select("hit_id"), "hit_id", "left_anti")
    if variant == "limited":
        enough = covered_bases(good, "qseqid", "qstart", "qend").join(lengths, "qseqid").filter(F.col("covered") >= F.col("gene_length") * share)
        enough = enough.join(pairwise_overlaps(good).filter(F.col("overlap") <= overlap), "qseqid", "left_semi")
    else:
        enough = good.groupBy("qseqid").agg(F.sum("length").alias("added")).join(lengths, "qseqid").filter(F.col("added") >= F.col("gene_length") * share)
    return good.join(enough.select("qseqid"), "qseqid", "left_semi").select("hit_id", "qseqid")


def with_fragments(hits: DataFrame, genes: DataFrame, *, identity: float = 0.95, share: float = 0.95, **how: object) -> DataFrame:
    """Kept hits, and the fragments of genes that no hit locates by itself but some hit touches. how: see ``fragmented``."""
    kept = classified(hits, genes, identity=identity, share=share).filter("verdict = 'kept'")
    candidates = hits.join(unlocated(kept, hits, genes), F.col("qseqid") == F.col("gene_id"), "left_semi")
    return kept.select("hit_id", "qseqid").unionByName(fragmented(candidates, genes, identity=identity, share=share, **how)).distinct()
