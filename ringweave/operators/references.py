"""Reference sequences: dereplication, identical and near-identical references, gene databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.functions.sequences import replicon_accessions, reverse_complement, without_version


def dereplicated(df: DataFrame, seq: str, *order: str) -> DataFrame:
    """The first row of each different sequence, in the given order; by an aggregate, so no sequence is too frequent.

    Sequences are told apart by 256-bit digests, so that their letters are no key of the shuffle.
    """
    first = df.groupBy(F.sha2(seq, 256).alias("__key")).agg(F.min(F.struct(*order, seq)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) for c in (*order, seq)])


def strandless(seq: str):
    """The same value for a sequence and its reverse complement."""
    return F.least(F.col(seq), reverse_complement(seq))


def identical_groups(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, ``representative``, ``size``): records whose sequences are equal or reverse complements of each other, by 256-bit digests."""
    keyed = df.select(key, F.sha2(strandless(seq), 256).alias("__s"))
    groups = keyed.groupBy("__s").agg(F.min(key).alias("representative"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(groups, "__s").select(key, "representative", "size")


def symmetric_pairs(hits: DataFrame, lengths: DataFrame, *, identity: float = 95.0, share: float = 0.95) -> DataFrame:
    """Pairs q < s with a hit that is similar enough and covers the given share of both sequences.

    lengths: (contig, length). Self-hits are left out.
    """
    good = hits.filter((F.col("qseqid") < F.col("sseqid")) & (F.col("pident") >= identity))
    q, s = (lengths.select(F.col("contig").alias(k), F.col("length").alias(f"{k}_length")) for k in ("qseqid", "sseqid"))
    both = good.join(q, "qseqid").join(s, "sseqid").filter((F.col("length") >= share * F.col("qseqid_length")) & (F.col("length") >= share * F.col("sseqid_length")))
    return both.select("qseqid", "sseqid").distinct()


def not_identical(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Hits that show a difference: identity, length of either sequence, mismatches or gaps."""
    q, s = (lengths.select(F.col("contig").alias(k), F.col("length").alias(f"{k}_length")) for k in ("qseqid", "sseqid"))
    both = hits.join(q, "qseqid").join(s, "sseqid")
    return both.filter((F.col("pident") < 100) | (F.col("length") != F.col("qseqid_length")) | (F.col("length") != F.col("sseqid_length")) | (F.col("mismatch") > 0) | (F.col("gapopen") > 0))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: different values in either set, in both, and only in the first, from one aggregate over their union."""
    seen = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = seen.groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.agg(F.count("*").alias("either"), F.count_if(F.col("x") + F.col("y") == 2).alias("both"), F.count_if(F.col("y") == 0).alias("only_first"))


def database(plasmids: DataFrame, genes: DataFrame, blacklist: DataFrame, *, released_before: str | None = None, plasmid_range: tuple[int, int] = (0, 2**31 - 1), min_gene: int = 0, dereplicate: bool = True) -> DataFrame:
    """Genes of the plasmids that qualify: (plasmid, gene_no, seq).

    plasmids: (plasmid, length, release_date as ISO text); genes: (plasmid, gene_no, seq); blacklist: (plasmid). Dates are
    compared as text, strictly; a plasmid without a date does not qualify if a date is asked for. Lengths are inclusive.
    Of equal sequences the one of the smallest plasmid and gene number stays.
    """
    good = plasmids.join(blacklist, "plasmid", "left_anti").filter(F.col("length").between(*plasmid_range))
    if released_before is not None:
        good = good.filter(F.col("release_date") < released_before)
    found = genes.join(good.select("plasmid"), "plasmid", "left_semi").filter(F.length("seq") >= min_gene)
    return dereplicated(found, "seq", "plasmid", "gene_no").select("plasmid", "gene_no", "seq") if dereplicate else found


def database_counts(plasmids: DataFrame, genes: DataFrame, blacklist: DataFrame, found: DataFrame, *, released_before: str | None = None, plasmid_range: tuple[int, int] = (0, 2**31 - 1), min_gene: int = 0) -> DataFrame:
    """One row: plasmids read, on the blacklist, outside the lengths, too late, used; genes read, too short, used."""
    listed = plasmids.join(blacklist.select("plasmid").distinct().withColumn("black", F.lit(True)), "plasmid", "left")
    black, late = F.col("black").isNotNull(), F.lit(False) if released_before is None else ~F.coalesce(F.col("release_date") < released_before, F.lit(False))
    fits = F.coalesce(F.col("length").between(*plasmid_range), F.lit(False))
    p = listed.agg(F.count("*").alias("plasmids"), F.count_if(black).alias("blacklisted"), F.count_if(~black & ~fits).alias("wrong_length"), F.count_if(~black & fits & late).alias("late"), F.count_if(~black & fits & ~late).alias("used"))
    g = genes.agg(F.count("*").alias("genes"), F.count_if(F.length("seq") < min_gene).alias("short_genes"))
    return p.join(g, F.lit(True)).join(found.agg(F.count("*").alias("genes_used")), F.lit(True))  # one row each


def tabled(rows: DataFrame, *, source: str = "both", released_before: str | None = None) -> DataFrame:
    """(accession): the different accessions, without versions, that a table of plasmids names and that were released in time.

    rows: ``Replicons``, several in one field separated by semicolons, and ``Release Date``, compared as text, strictly.
    """
    if released_before is not None:
        rows = rows.filter(F.col("`Release Date`") < released_before)
    each = rows.select(F.explode(F.split("Replicons", ";")).alias("replicon")).select(F.trim("replicon").alias("replicon"))
    names = replicon_accessions("replicon", source)
    names = F.explode(names) if source == "both" else names
    return each.select(names.alias("a")).filter("a is not null and a <> ''").select(without_version("a").alias("accession")).distinct()
