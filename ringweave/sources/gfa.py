"""GFA version 1 files: segments, links, containments and paths, each with the file's name as sample_id.

Lines of other types, comments among them, are left out. Tags are found by name, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions.sequences import gc_fraction, overlap_length


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, ord, parts): ord follows a file's lines; the name is that of the file, or of a folder sample_id=name."""
    folder = F.regexp_extract("_metadata.file_path", r"/sample_id=([^/]+)/", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.(gfa|txt)(\.\w+)?$", ""))
    # Lines of one part of a file are numbered in order; parts are in the order of their places.
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(name.alias("sample_id"), order.alias("ord"), F.split(F.rtrim("value"), "\t").alias("parts"))


def _tag(name: str, first: int, kind: str) -> Column:
    found = F.filter("parts", lambda p, i: (i >= first - 1) & p.startswith(f"{name}:"))
    return F.try_element_at(F.split(F.try_element_at(found, F.lit(1)), ":"), F.lit(3)).try_cast(kind)


def _part(i: int) -> Column:
    return F.try_element_at("parts", F.lit(i))


def segments(lines: DataFrame) -> DataFrame:
    """Lengths missing from the tags come from the sequence, depths from the k-mers; '*' is an absent sequence."""
    seq = _part(3)
    length = F.coalesce(_tag("LN", 4, "int"), F.when(seq != "*", F.length(seq)))
    rows = lines.filter(_part(1) == "S").select(
        "sample_id", "ord", _part(2).alias("seg_name"), seq.alias("seq"), length.alias("length"), _tag("RC", 4, "bigint").alias("read_count"), _tag("FC", 4, "bigint").alias("frag_count"),
        _tag("KC", 4, "bigint").alias("kmer_count"), _tag("dp", 4, "double").alias("dp"),
    )
    return rows.select("*", F.coalesce("dp", F.try_divide("kmer_count", "length")).alias("depth"), gc_fraction("seq").alias("gc")).drop("dp")


def links(lines: DataFrame) -> DataFrame:
    names = [_part(i + 2).alias(n) for i, n in enumerate(("from_seg", "from_ori", "to_seg", "to_ori", "overlap"))]
    tags = [_tag(t, 7, "bigint").alias(n) for t, n in (("MQ", "map_quality"), ("NM", "differences"), ("RC", "read_count"), ("FC", "frag_count"), ("KC", "kmer_count"))]
    return lines.filter(_part(1) == "L").select("sample_id", "ord", *names, *tags).withColumn("overlap_length", overlap_length("overlap"))


def link_tags(found: DataFrame) -> DataFrame:
    """Tags by pair of segments, whatever the orientations; the last line of a pair counts."""
    tags = ("map_quality", "differences", "read_count", "frag_count", "kmer_count")
    return found.groupBy("sample_id", F.least("from_seg", "to_seg").alias("a"), F.greatest("from_seg", "to_seg").alias("b")).agg(*[F.max_by(t, F.when(F.col(t).isNotNull(), F.col("ord"))).alias(t) for t in tags])


def containments(lines: DataFrame) -> DataFrame:
    names = [_part(i + 2).alias(n) for i, n in enumerate(("container", "container_ori", "containee", "containee_ori", "pos", "overlap"))]
    rows = lines.filter(_part(1) == "C").select("sample_id", "ord", *names, _tag("RC", 8, "bigint").alias("read_count"), _tag("NM", 8, "bigint").alias("differences"))
    return rows.withColumn("pos", F.col("pos").try_cast("int"))


def paths(lines: DataFrame) -> DataFrame:
    """One row for each step of a path, in order."""
    rows = lines.filter(_part(1) == "P").select("sample_id", _part(2).alias("path"), _part(4).alias("overlaps"), F.posexplode(F.split(_part(3), ",")).alias("step", "s"))
    return rows.select("sample_id", "path", (F.col("step") + 1).alias("step"), F.expr("substring(s, 1, length(s) - 1)").alias("segment"), F.right("s", F.lit(1)).alias("orientation"), "overlaps")


def segment_lines(df: DataFrame) -> DataFrame:
    """S lines of segments (seg_name, seq, and those of length, kmer_count, depth that are known)."""
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    return df.select("sample_id", F.concat_ws("\t", F.lit("S"), "seg_name", "seq", tag("LN:i", "length"), tag("KC:i", "kmer_count"), tag("dp:f", "depth")).alias("value"))


def link_lines(df: DataFrame, *tags: Column) -> DataFrame:
    """L lines of links; tags: further fields such as 'MQ:i:60', null where a link has none."""
    return df.select("sample_id", F.concat_ws("\t", F.lit("L"), "from_seg", "from_ori", "to_seg", "to_ori", F.coalesce("overlap", F.lit("*")), *tags).alias("value"))
