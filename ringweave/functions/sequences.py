"""Expressions on sequences, coordinates and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# The IUPAC letters and their complements.
LETTERS = "ACGTURYSWKMBDHVN"
COMPLEMENTS = "TGCAAYRSWMKVHDBN"


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, LETTERS + LETTERS.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def gc_fraction(seq: Column | str) -> Column:
    """Share of g and c; 0 for an empty or absent ('*') sequence."""
    size = F.length(seq)
    return F.when(size > 0, (size - F.length(F.translate(seq, "GgCc", ""))) / size).otherwise(F.lit(0.0))


def species(organism: Column | str) -> Column:
    """The first two words of an organism's name."""
    return F.substring_index(organism, " ", 2)


def abbreviation(organism: Column | str) -> Column:
    """Initials of the words, each with a full stop."""
    return F.concat(F.array_join(F.transform(F.split(organism, " "), lambda w: F.left(w, F.lit(1))), "."), F.lit("."))


def without_version(accession: Column | str) -> Column:
    return F.substring_index(accession, ".", 1)


def accession_in(label: Column | str) -> Column:
    """The plasmid accession in a definition line, however it is written; null if there is none."""
    number = F.regexp_extract(label, r"(?i)NZ[^A-Za-z0-9]?PL([0-9]+)\.[0-9]+", 1)
    version = F.regexp_extract(label, r"(?i)NZ[^A-Za-z0-9]?PL[0-9]+\.([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("NZ_PL"), number, F.lit("."), version))


def replicon_accessions(replicon: Column | str, source: str = "refseq") -> Column:
    """Accessions of a replicon written as name:REFSEQ/GENBANK, of which each part but one may be missing.

    source: 'refseq' (before the slash), 'genbank' (behind it, null if empty) or 'both' (an array of all that are there).
    """
    parts = F.split(F.substring_index(replicon, ":", -1), "/")
    if source == "both":
        return F.filter(parts, lambda p: p != "")
    return F.nullif(F.element_at(parts, 1 if source == "refseq" else -1), F.lit(""))


def flip(start: Column, end: Column, length: Column, strand: Column) -> list[Column]:
    """0-based ends on the given strand. On '-', positions are one high, as in the published densities."""
    minus = strand == "-"
    return [F.when(minus, length - end).otherwise(start).alias("start"), F.when(minus, length - start).otherwise(end).alias("end")]


def wrapped(start: Column, end: Column, length: Column) -> Column:
    """Array of the pieces of a 0-based interval on a ring of the given length, the whole ring if it is as long as that."""
    piece = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    return (
        F.when(end < length, F.array(piece(start, end)))
        .when(end - start + 1 >= length, F.array(piece(F.lit(0), length - 1)))
        .when(start % length > end % length, F.array(piece(start % length, length - 1), piece(F.lit(0), end % length)))
        .otherwise(F.array(piece(start % length, end % length)))
    )


def step_score(ratio, density_to, gc_diff, weights: tuple, absolute):
    """How badly a contig with ratio times a chain's depth continues it; of numbers or, with their absolute, of columns."""
    return weights[0] * absolute(1 - ratio) + weights[1] * (1 - density_to) + weights[2] * absolute(gc_diff)


def extension_score(depth: Column, gc: Column, depth_to: Column, density_to: Column, gc_to: Column, weights: dict[str, float]) -> Column:
    """The score of a step by columns; a chain without depth cannot be continued."""
    score = step_score(F.try_divide(depth_to, depth), density_to, gc - gc_to, (weights["depth_diff"], weights["gene_density"], weights["gc_diff"]), F.abs)
    return F.when(depth == 0, F.lit(float("inf"))).otherwise(score)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def per_thousand(count: Column, length: Column) -> Column:
    """Null for a length of 0."""
    return 1000 * F.try_divide(count, length)


def weight_map(text: Column | str) -> Column:
    """'a=1,b=?' as a map; null stands for a weight that is to be taken from the data."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.try_cast("double"))


def overlap_length(cigar: Column | str) -> Column:
    """Length of a simple CIGAR such as 55M; 0 for '*', compound ones and null."""
    text = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.coalesce(F.substring(text, F.lit(1), F.length(text) - 1).try_cast("int"), F.lit(0))


@F.pandas_udf(IntegerType())
def suffix_prefix_overlap(seq: pd.Series) -> pd.Series:
    """Length of the longest proper suffix of a sequence that is also its prefix, in linear time; null for null."""

    def longest(s: str | None) -> int | None:
        if s is None:
            return None
        border, k = [0] * len(s), 0
        for i in range(1, len(s)):
            while k and s[i] != s[k]:
                k = border[k - 1]
            k += s[i] == s[k]
            border[i] = k
        return border[-1] if s else 0

    return seq.map(longest, na_action=None).astype("Int32")
