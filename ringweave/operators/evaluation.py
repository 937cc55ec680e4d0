"""Scores of predictions against references, per tool, sample, organism and level; translocations.

References are (tool, sample_id, plasmid_id, length, best_recall, union_recall), predictions the same with precision.
Null scores count as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringweave.functions.sequences import f1
from ringweave.operators.sweep import periods_and_gaps


def _share(score: str) -> Column:
    return F.try_divide(F.sum(F.col("length") * F.coalesce(score, F.lit(0.0))), F.sum("length"))


def scores(refs: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``evaluation`` ('best' or 'union'), length-weighted precision and recall, and f1; 0 without predictions."""
    recall = refs.groupBy(*keys).agg(_share("best_recall").alias("rb"), _share("union_recall").alias("ru"))
    precision = preds.groupBy(*keys).agg(_share("best_precision").alias("pb"), _share("union_precision").alias("pu"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("best").alias("evaluation"), zero("pb").alias("precision"), zero("rb").alias("recall")),
        F.struct(F.lit("union").alias("evaluation"), zero("pu").alias("precision"), zero("ru").alias("recall")),
    )
    long = recall.join(precision, keys, "left").select(*keys, F.inline(rows))
    return long.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def truncated_totals(refs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``recalled`` (whole positions), ``total``: recalled positions are truncated record by record."""
    nt = (F.col("length") * F.coalesce("union_recall", F.lit(0.0))).cast("bigint")
    return refs.groupBy(*keys).agg(F.sum(nt).alias("recalled"), F.sum("length").cast("bigint").alias("total"))


def differences(per_sample: DataFrame, baseline: str, value: str) -> DataFrame:
    """(sample_id, tool, difference): the baseline tool's value minus that of every other tool."""
    base = per_sample.filter(F.col("tool") == baseline).select("sample_id", F.col(value).alias("__base"))
    return per_sample.filter(F.col("tool") != baseline).join(base, "sample_id").select("sample_id", "tool", (F.col("__base") - F.col(value)).alias("difference"))


def high_quality(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.filter((F.col("recall") >= threshold) & (F.col("precision") >= threshold))


def one_way(refs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per tool: references, those found well by one prediction and by all, and the share of their length."""
    good = F.coalesce("best_recall", F.lit(0.0)) >= threshold
    return refs.groupBy("tool").agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_best"), F.count_if(F.coalesce("union_recall", F.lit(0.0)) >= threshold).alias("n_union"),
        F.try_divide(F.sum(F.when(good, F.col("length")).otherwise(0)), F.sum("length")).alias("length_share"),
    )


def zero_filled(rows: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every wanted key, with zeros and ``missing`` where there is no row."""
    joined = wanted.select(*keys).distinct().join(rows.withColumn("__there", F.lit(True)), keys, "left")
    return joined.select(*keys, *[F.coalesce(v, F.lit(0)).alias(v) for v in values], F.col("__there").isNull().alias("missing"))


def levels(total: int, step: int) -> Column:
    """[0, step, 2 step, ..., total] as an array; the last step may be shorter. For totals known to be small."""
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(total), F.lit(step)), F.array(F.lit(total))))


def level_scores(refs: DataFrame, order: list[str], step: int = 20) -> DataFrame:
    """(tool, level, repetitions, recall): length-weighted union recall of a tool's first 0, step, 2 step, ..., all references.

    Only the levels between none and all are repeated. order: columns by which references are taken; the last of them
    may be anything that ranks equal ones. Running sums are taken over blocks of the first column's beginnings, so no tool is one
    sorted task.
    """
    length = F.col("length").cast("double")
    rows = refs.select("tool", *order, length.alias("__l"), (length * F.coalesce("union_recall", F.lit(0.0))).alias("__r"), F.substring(order[0], 1, 11).alias("__block"))
    blocks = rows.groupBy("tool", "__block").agg(F.count("*").alias("__n"), F.sum("__l").alias("__bl"), F.sum("__r").alias("__br"))
    over = Window.partitionBy("tool")
    upto = over.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    before = blocks.select("tool", "__block", *[(F.sum(c).over(upto) - F.col(c)).alias(f"__before{c}") for c in ("__n", "__bl", "__br")], F.sum("__n").over(over).alias("__all"))
    inside = Window.partitionBy("tool", "__block").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("tool", "__block", F.row_number().over(inside).alias("__i"), F.sum("__l").over(running).alias("__il"), F.sum("__r").over(running).alias("__ir")).join(before, ["tool", "__block"])
    placed = placed.select("tool", (F.col("__before__n") + F.col("__i")).cast("int").alias("level"), F.col("__all"), F.try_divide(F.col("__before__br") + F.col("__ir"), F.col("__before__bl") + F.col("__il")).alias("recall"))
    none = placed.select("tool", F.lit(0).alias("level"), "__all", F.lit(0.0).alias("recall")).distinct()
    found = placed.filter((F.col("level") % step == 0) | (F.col("level") == F.col("__all"))).unionByName(none)
    return found.select("tool", "level", F.when((F.col("level") == 0) | (F.col("level") == F.col("__all")), 1).otherwise(3).alias("repetitions"), "recall")


def translocations(hits: DataFrame, lengths: DataFrame, *, side: str = "q", by: list[str] = ()) -> DataFrame:
    """Per record: its best partner, and the shares of its positions that the partner covers, only others do, none does.

    The best partner covers most positions, the smaller name of equal ones. What only others cover is the union of all
    stretches less that of the best, so no stretch is cut. lengths: (contig, length); self-hits are left out. Covered
    positions beyond a record's length count as its last ones. by: further columns of both tables whose values are kept apart.
    """
    me, other, a, b = ("qseqid", "sseqid", "qstart", "qend") if side == "q" else ("sseqid", "qseqid", "sstart", "send")
    rows = hits.filter(F.col("qseqid") != F.col("sseqid")).select(*by, F.col(me).alias("contig"), F.col(other).alias("partner"), F.col(a).alias("a"), F.col(b).alias("b"))
    covered = lambda keys: periods_and_gaps(rows, keys, {"": ("a", "b")}).filter("kind = 'period'").groupBy(*keys).agg(F.sum(F.col("pos_to") - F.col("pos_from") + 1).alias("n"))
    best = covered([*by, "contig", "partner"]).groupBy(*by, "contig").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("partner"))).alias("best"))
    every = covered([*by, "contig"]).withColumnRenamed("n", "any")
    joined = lengths.select(*by, "contig", "length").join(best, [*by, "contig"], "left").join(every, [*by, "contig"], "left")
    matched, touched = F.least(F.coalesce(-F.col("best.n"), F.lit(0)), F.col("length")), F.least(F.coalesce("any", F.lit(0)), F.col("length"))
    return joined.select(
        *by, "contig", "length", F.col("best.partner").alias("partner"), F.try_divide(matched, F.col("length")).alias("matched"),
        F.try_divide(touched - matched, F.col("length")).alias("translocated"), F.try_divide(F.col("length") - touched, F.col("length")).alias("unaligned"),
    )


def binned(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits whose subject is a member of a bin, with the bin in place of the subject: a bin's stretches are those of all its members.

    members: (contig, bin), and further columns, which the hits get. A contig in several bins gives a hit for each.
    """
    return hits.join(members.withColumnRenamed("contig", "sseqid"), "sseqid").drop("sseqid").withColumnRenamed("bin", "sseqid")


def scores_from_totals(refs: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, evaluation, precision, recall, f1 from totals of translocations: matched shares are 'best', matched and translocated ones 'union'."""
    rows = lambda df, out: df.select(*keys, F.inline(F.array(F.struct(F.lit("best").alias("evaluation"), F.col("matched").alias(out)), F.struct(F.lit("union").alias("evaluation"), (F.col("matched") + F.col("translocated")).alias(out)))))
    joined = rows(refs, "recall").join(rows(preds, "precision"), [*keys, "evaluation"])
    return joined.select(*keys, "evaluation", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def translocation_totals(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched records, the share of them with a translocation, and length-weighted shares."""
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("length")), F.sum("length")).alias(c)
    n = F.count_if(F.col("matched") > 0)
    return found.groupBy(*keys).agg(n.alias("n_matched"), F.try_divide(F.count_if((F.col("matched") > 0) & (F.col("translocated") > 0)), n).alias("translocated_records"), w("matched"), w("translocated"), w("unaligned"))


def unpivoted(df: DataFrame, keys: str | list[str], columns: list[str], name: str = "metric", value: str = "value", kind: str = "string") -> DataFrame:
    """Wide to long, values of one kind; a missing column gives no rows."""
    there = [c for c in columns if c in df.columns]
    keys = [keys] if isinstance(keys, str) else keys
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in there])))


def united(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def covered_length(refs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per tool: share of the length of all different references that some prediction covers well."""
    each = refs.groupBy("tool", "plasmid_id").agg(F.max("length").alias("length"), F.max(F.coalesce("best_recall", F.lit(0.0))).alias("best"))
    return each.groupBy("tool").agg(F.try_divide(F.sum(F.when(F.col("best") >= threshold, F.col("length")).otherwise(0)), F.sum("length")).alias("share"))


def count_ratios(refs: DataFrame, part: Column) -> DataFrame:
    """Per tool: rows, rows of which part holds, and their ratio."""
    n = F.count_if(part)
    return refs.groupBy("tool").agg(F.count("*").alias("n"), n.alias("n_part"), (n / F.count("*")).alias("ratio"))


def sweep_table(runs: dict[str, DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Results of runs with different parameters as one long table with the run's name."""
    return united(*[df.select(F.lit(name).alias("run"), *keys, *values) for name, df in runs.items()])


def largest_alignments(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """(sample_id, mean_length, largest, share): a sample's largest alignment with another sample's record, 0 if none, against the mean length of its own.

    contigs: (contig, length, sample_id).
    """
    mean = contigs.groupBy("sample_id").agg(F.avg("length").alias("mean_length"))
    q, s = (contigs.select(F.col("contig").alias(k), F.col("sample_id").alias(f"{k}_sample")) for k in ("qseqid", "sseqid"))
    across = hits.select("qseqid", "sseqid", F.col("length").alias("n")).join(q, "qseqid").join(s, "sseqid").filter("qseqid_sample <> sseqid_sample")
    largest = across.groupBy(F.col("qseqid_sample").alias("sample_id")).agg(F.max("n").alias("largest"))
    joined = mean.join(largest, "sample_id", "left").withColumn("largest", F.coalesce("largest", F.lit(0)))
    return joined.withColumn("share", F.try_divide("largest", "mean_length"))
