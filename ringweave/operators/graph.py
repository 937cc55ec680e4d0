"""Assembly graphs: oriented edges, degrees, components, graph statistics; all per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.functions.sequences import gc_fraction, overlap_length
from ringweave.operators.weighted import deviations, mean_of, n50, places, quantiles
from ringweave.session import Scratch


def normal_segments(segments: DataFrame) -> DataFrame:
    """Segments with length from the sequence and depth from the k-mers where they are missing, and GC content."""
    length = F.coalesce(F.col("length"), F.when(F.col("seq") != "*", F.length("seq")))
    return segments.select("sample_id", "seg_name", "seq", length.alias("length"), "kmer_count", F.coalesce("depth", F.try_divide(F.col("kmer_count"), length)).alias("depth"), gc_fraction("seq").alias("gc"))


def edges(links: DataFrame) -> DataFrame:
    """Each link in both directions: leaving src in src_ori means entering dst in dst_ori, and the mirror image.

    A column ``ord``, the links' order, is kept if there is one.
    """
    kept = ["ord"] if "ord" in links.columns else []
    flip = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    ov = overlap_length("overlap")
    forth = links.select("sample_id", F.col("from_seg").alias("src"), F.col("from_ori").alias("src_ori"), F.col("to_seg").alias("dst"), F.col("to_ori").alias("dst_ori"), ov.alias("overlap"), *kept)
    back = links.select("sample_id", F.col("to_seg").alias("src"), flip("to_ori").alias("src_ori"), F.col("from_seg").alias("dst"), flip("from_ori").alias("dst_ori"), ov.alias("overlap"), *kept)
    return forth.unionByName(back)


def neighbours(links: DataFrame) -> DataFrame:
    """Different (sample_id, src, dst), whatever the orientations."""
    return edges(links).select("sample_id", "src", "dst").distinct()


def degrees(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Link ends at each segment: a link to itself counts twice, repeated links each time; 0 without links."""
    ends = links.select("sample_id", F.explode(F.array("from_seg", "to_seg")).alias("seg_name"))
    counts = ends.groupBy("sample_id", "seg_name").agg(F.count("*").alias("n"))
    return segments.select("sample_id", "seg_name").join(counts, ["sample_id", "seg_name"], "left").select("sample_id", "seg_name", F.coalesce("n", F.lit(0)).alias("degree"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(v, u) for each pair (a, b), from either side."""
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))


def _star_step(pairs: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on pairs a < b."""
    if large:
        near = both_ways(pairs)
        least = near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        moved = near.filter("u > v").join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        least = pairs.groupBy("b").agg(F.min("a").alias("m"))
        moved = pairs.join(least, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))))
    return moved.filter("a <> b").distinct()


def _unsettled(pairs: DataFrame) -> DataFrame:
    """Vertices of pairs a < b that are a centre and have one, or have several: none, once all pairs form stars."""
    role = lambda v, centre: F.struct(F.col(v).alias("v"), F.lit(centre).alias("centre"), F.lit(1 - centre).alias("leaf"))
    roles = pairs.select(F.inline(F.array(role("a", 1), role("b", 0))))
    return roles.groupBy("v").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).filter("leaf > 1 or (centre = 1 and leaf = 1)")


def star_labels(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) of every vertex in pairs a < b: the smallest vertex of its component, by alternating star steps.

    The rounds grow with the logarithm of the vertices; smallest neighbours are found with map-side combining.
    """
    step = 0
    while True:
        pairs = scratch.write(_star_step(_star_step(pairs, True), False), f"stars{step}")
        if step:
            scratch.drop(f"stars{step - 1}")
        if _unsettled(pairs).isEmpty():
            return pairs.select(F.col("b").alias("v"), F.col("a").alias("label")).unionByName(pairs.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct())
        step += 1


def components(segments: DataFrame, links: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(sample_id, seg_name, component): the smallest segment name of each segment's component.

    only: (sample_id, seg_name) of an induced subgraph; other segments and their links are left out.
    """
    nodes = segments.select("sample_id", "seg_name")
    pairs = links.select("sample_id", "from_seg", "to_seg")
    if only is not None:
        keep = only.select("sample_id", "seg_name").distinct()
        nodes = nodes.join(keep, ["sample_id", "seg_name"], "left_semi")
        for end in ("from_seg", "to_seg"):
            pairs = pairs.join(keep.select("sample_id", F.col("seg_name").alias(end)), ["sample_id", end], "left_semi")
    key = lambda c: F.concat(F.col("sample_id").cast("string"), F.lit("\t"), F.col(c))
    pairs = pairs.filter("from_seg <> to_seg").select(F.least(key("from_seg"), key("to_seg")).alias("a"), F.greatest(key("from_seg"), key("to_seg")).alias("b")).distinct()
    labels = star_labels(pairs, Scratch(segments.sparkSession, "components")).select("v", F.substring_index("label", "\t", -1).alias("label"))
    found = nodes.withColumn("v", key("seg_name")).join(labels, "v", "left")
    return found.select("sample_id", "seg_name", F.coalesce("label", "seg_name").alias("component"))


def graph_statistics(segments: DataFrame, links: DataFrame) -> DataFrame:
    """The twelve characteristics of each sample's graph."""
    length = normal_segments(segments).select("sample_id", "seg_name", F.coalesce("length", F.lit(0)).alias("length"))
    per_seg = length.join(degrees(segments, links), ["sample_id", "seg_name"]).join(components(segments, links), ["sample_id", "seg_name"])
    by, middle = ["sample_id"], lambda df, value, name: quantiles(df, ["sample_id"], value, {name: 0.5})
    per_seg = Scratch(segments.sparkSession, "statistics").write(per_seg, "segments")  # read for each of the statistics
    base = per_seg.groupBy(*by).agg(
        F.avg("degree").alias("mean_degree"), F.avg("length").alias("mean_length"), F.count_if(F.col("degree") == 1).alias("dead_ends"),
        F.try_divide(F.count_if(F.col("degree") == 1), F.count_if(F.col("degree") > 0)).alias("dead_end_share"),
    )
    sizes = per_seg.groupBy("sample_id", "component").agg(F.sum("length").alias("nt"), F.count("*").alias("n"))
    comps = sizes.groupBy(*by).agg(F.count("*").alias("n_components"), (F.sum("nt") / F.count("*")).alias("mean_component_nt"), (F.sum("n") / F.count("*")).alias("mean_component_segments"))
    for more in (
        comps, middle(per_seg, "degree", "median_degree"), middle(per_seg, "length", "median_length"), middle(sizes, "nt", "median_component_nt"), middle(sizes, "n", "median_component_segments"),
        n50(per_seg, by, "length"),
    ):
        base = base.join(more, by, "left")
    return base


def representatives(segments: DataFrame, links: DataFrame) -> DataFrame:
    """The longest segment of each component, the smaller name of equally long ones."""
    length = normal_segments(segments).select("sample_id", "seg_name", F.coalesce("length", F.lit(0)).alias("length"))
    joined = length.join(components(segments, links), ["sample_id", "seg_name"])
    best = joined.groupBy("sample_id", "component").agg(F.min(F.struct(-F.col("length"), F.col("seg_name"))).alias("b"))
    return best.select("sample_id", "component", F.col("b.seg_name").alias("seg_name"))


def seeds(segments: DataFrame, links: DataFrame, densities: DataFrame, *, min_depth: float, min_density: float, max_length: int) -> DataFrame:
    """Eligible segments with their place in the order in which they are tried, 1 first.

    densities: (sample_id, seg_name, density). Branching segments are tried behind unambiguous ones, within either the
    lower sums of normalised density and GC difference later; the larger name first where they are equal to 9 decimals.
    No sample is one sorted task: places are counted over blocks of these sums.
    """
    normal = normal_segments(segments).join(densities, ["sample_id", "seg_name"])
    overall = normal_segments(segments).filter("length is not null").groupBy("sample_id").agg(mean_of("gc", "length").alias("overall_gc"))
    able = normal.filter((F.col("depth") >= min_depth) & (F.col("density") >= min_density) & (F.col("length") <= max_length)).join(overall, "sample_id")
    able = able.withColumn("gc_diff", F.abs(F.col("gc") - F.col("overall_gc")))
    spread = deviations(able, ["sample_id"], ["density", "gc_diff"], "length")
    one = lambda c: F.when(F.col(c) < 1e-7, 1.0).otherwise(F.col(c))
    z = (F.col("density") - F.col("density_mean")) / one("density_sd") + (F.col("gc_diff") - F.col("gc_diff_mean")) / one("gc_diff_sd")
    ways = edges(links).groupBy("sample_id", F.col("src").alias("seg_name")).agg(F.count_if(F.col("src_ori") == "+").alias("out"), F.count_if(F.col("src_ori") == "-").alias("into"))
    ranked = able.join(spread, "sample_id").join(ways, ["sample_id", "seg_name"], "left").withColumn("z", z)
    plain = (F.coalesce("out", F.lit(0)) <= 1) & (F.coalesce("into", F.lit(0)) <= 1)
    ranked = ranked.withColumn("unambiguous", plain).select("sample_id", "seg_name", "length", "depth", "density", "gc", "z", "unambiguous", (-F.round("z", 9)).alias("__z"))
    placed = places(ranked, ["sample_id", "unambiguous"], "__z", F.desc("seg_name"))
    first = ranked.groupBy("sample_id").agg(F.count_if("unambiguous").cast("int").alias("__plain"))
    behind = F.col("place") + F.when(F.col("unambiguous"), 0).otherwise(F.col("__plain"))
    return placed.join(first, "sample_id").select("sample_id", "seg_name", "length", "depth", "density", "gc", "z", "unambiguous", behind.alias("place"))
