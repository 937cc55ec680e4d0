"""FASTA and GenBank files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions.sequences import COMPLEMENTS, LETTERS
from ringweave.session import Scratch
from ringweave.sources.files import file_label


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, description, seq); the id ends at the first blank. Records are split at '>', which starts a line."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(file_label().alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = raw.filter("trim(value) <> ''").select("file", F.element_at(lines, 1).alias("head"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))
    return rows.select("file", F.regexp_extract("head", r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("description"), F.regexp_replace("seq", r"\s", "").alias("seq"))


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lines that start a record."""
    return spark.read.text(path).filter("value like '>%'").groupBy(file_label().alias("file")).agg(F.count("*").alias("n"))


def component_counts(records: DataFrame) -> DataFrame:
    """(file, n): different components named at the end of the ids."""
    return records.groupBy("file").agg(F.count_distinct(F.substring_index("id", "component_", -1)).alias("n"))


def write_fasta(df: DataFrame, path: str, *, head: str, seq: str, append: bool = False, by: list[str] = ()) -> None:
    """One record for each row: a column with the definition line, and one with the sequence. by: a folder for each value."""
    lines = df.select(*by, F.concat(F.lit(">"), F.col(head), F.lit("\n"), F.col(seq)).alias("value"))
    writer = lines.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def extend_fasta(spark: SparkSession, df: DataFrame, path: str, *, head: str, seq: str) -> None:
    """Adds the sequences that the files do not have yet, each once under the smallest of its definition lines."""
    known = read_fasta(spark, path).select("seq").distinct()
    new = df.select(F.col(head).alias("head"), F.col(seq).alias("seq")).groupBy("seq").agg(F.min("head").alias("head")).join(known, "seq", "left_anti")
    write_fasta(Scratch(spark, "extension").write(new, "new"), path, head="head", seq="seq", append=True)


GENE = re.compile(r"^ {5}(\S+) +(\S.*)$")
QUALIFIER = re.compile(r'^ {21}/(\w+)(?:="?([^"]*)"?)?$')
RANGE = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")
OPPOSITE = str.maketrans(LETTERS + LETTERS.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def _extract(location: str, seq: str) -> str:
    """Letters at a location such as complement(join(1..5,9..12))."""
    inner = re.fullmatch(r"complement\((.*)\)", location)
    if inner:
        return _extract(inner[1], seq).translate(OPPOSITE)[::-1]
    inner = re.fullmatch(r"(?:join|order)\((.*)\)", location)
    if inner:
        return "".join(_extract(x, seq) for x in re.findall(r"complement\([^()]*\)|[^,]+", inner[1]))
    found = RANGE.fullmatch(location)
    return seq[int(found[1]) - 1 : int(found[2] or found[1])] if found else ""


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for file, text in zip(frame.file, frame.value):
            head, _, origin = text.partition("\nORIGIN")
            seq = "".join(re.findall(r"[A-Za-z]+", origin.partition("\n")[2])).upper()
            name = re.search(r"^LOCUS +(\S+)", head, re.M)
            features, current = [], None
            for line in head.partition("\nFEATURES")[2].split("\n"):
                start, more = GENE.match(line), QUALIFIER.match(line)
                if start:
                    current = [start[1], start[2], {}]
                    features.append(current)
                elif current and more:
                    current[2].setdefault(more[1], more[2] or "")
                elif current and line.startswith(" " * 21) and not current[2]:
                    current[1] += line.strip()
            genes = [f for f in features if f[0] == "gene"]
            for i, (_, location, tags) in enumerate(genes):
                key = tags.get("locus_tag") or (f"gene{i}_{tags['gene']}" if "gene" in tags else None)
                out.append((file, name[1] if name else None, len(seq), i, key, _extract(location, seq)))
            if not genes:
                out.append((file, name[1] if name else None, len(seq), None, None, seq if seq else None))
        yield pd.DataFrame(out, columns=["file", "record", "record_length", "gene_no", "gene_id", "seq"]).astype({"gene_no": "Int32"})


GENBANK = "file string, record string, record_length int, gene_no int, gene_id string, seq string"


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, record_length, gene_no, gene_id, seq): a row for each feature of type gene.

    gene_id is the locus tag, else gene<number>_<name>, else null; sequences are on the gene's strand. A record without
    genes has one row with its whole sequence and no gene_no; an undefined sequence is null.
    """
    raw = spark.read.option("lineSep", "\n//").text(path).select(file_label().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    return raw.filter("value like '%LOCUS%'").mapInPandas(_records, GENBANK)
