"""Hit tables, lists, and other delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS = (
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """BLAST outfmt 6 without header, with hit_id: unique, and ascending inside each part of a file that one task reads."""
    return spark.read.csv(path, sep="\t", schema=HITS, nullValue="NA").withColumn("hit_id", F.monotonically_increasing_id())


def write_hits(df: DataFrame, path: str) -> None:
    df.select(*[c.split()[0] for c in HITS.split(", ")]).write.mode("overwrite").csv(path, sep="\t", nullValue="NA", emptyValue="")


def read_delimited(spark: SparkSession, path: str, sep: str = ";", *, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, so that accessions and dates keep their form."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    return df.toDF(*columns) if columns else df


def read_list(spark: SparkSession, path: str, *, keep_blank: bool = False) -> DataFrame:
    """(value): one entry a line, trimmed."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows if keep_blank else rows.filter("value <> ''")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(file, bin, member): line i of a file lists the members of bin_i."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("i", "line"))
    return rows.filter("line <> ''").select("file", F.concat(F.lit("bin_"), "i").alias("bin"), F.explode(F.split("line", ",")).alias("member"))


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def write_bins(df: DataFrame, path: str) -> None:
    """(bin_no, place, member) as one line of members for each bin."""
    lines = df.groupBy("bin_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x.member), ",").alias("value"))
    lines.orderBy("bin_no").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)
