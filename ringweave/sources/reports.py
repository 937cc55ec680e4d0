"""Evaluation reports in sections, and assembly-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringweave.session import union_all
from ringweave.sources.files import file_label

# The headings of a report's sections, and the section's name.
SECTIONS = {
    "number of reference chromosomes": "chromosomes",
    "number of reference plasmids": "references",
    "number of predicted plasmids": "predictions",
    "> predicted plasmid covers <proportion> of reference plasmid": "ref_by_pred",
    "> reference plasmid covers <proportion> of predicted plasmid": "pred_by_ref",
    "> in total, how much of predicted plasmid": "pred_by_all",
    "> in total, how much of reference plasmid": "ref_by_all",
    "> pairs": "pairs",
    "> summary scores": "summary",
}


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, row, line): the lines of each section, numbered from 1, up to the end of the first summary."""
    rows = spark.read.text(path, wholetext=True).select(file_label().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    opens = F.lit(None).cast("string")
    for start, name in SECTIONS.items():
        opens = F.when(F.col("line").startswith(start), name).otherwise(opens)
    order = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("opens", opens).withColumn("ends", F.col("line").startswith("#####"))
    rows = rows.withColumn("section", F.last("opens", ignorenulls=True).over(order)).withColumn("summaries", F.sum(F.when(F.col("opens") == "summary", 1).otherwise(0)).over(order))
    rows = rows.withColumn("later", F.sum(F.when(F.col("ends") & (F.col("summaries") > 0), 1).otherwise(0)).over(order))
    inside = rows.filter("later = 0 and opens is null and not ends and line <> '' and section is not null and summaries < 2")
    return inside.select("file", "section", F.row_number().over(Window.partitionBy("file", "section").orderBy("pos")).alias("row"), "line")


def plasmids(sections: DataFrame, section: str) -> DataFrame:
    """(file, plasmid, length) of 'references', 'predictions' or 'chromosomes'."""
    found = lambda i: F.regexp_extract("line", r"^\t(.*): (\d+) nt", i)
    return sections.filter(F.col("section") == section).select("file", found(1).alias("plasmid"), found(2).cast("int").alias("length")).filter("plasmid <> ''")


def coverage(sections: DataFrame, section: str) -> DataFrame:
    """(file, row_id, column_id, proportion): a matrix in long form, its columns named by its first line."""
    rows = sections.filter(F.col("section") == section).withColumn("cells", F.split("line", "\t"))
    head = rows.filter("row = 1").select("file", F.col("cells").alias("names"))
    body = rows.filter("row > 1").select("file", F.element_at("cells", 1).alias("row_id"), F.posexplode("cells").alias("i", "cell")).filter("i > 0")
    return body.join(head, "file").select("file", "row_id", F.try_element_at("names", F.col("i") + 1).alias("column_id"), F.col("cell").try_cast("double").alias("proportion"))


def totals(sections: DataFrame, section: str) -> DataFrame:
    """(file, plasmid, proportion)."""
    rows = sections.filter((F.col("section") == section) & (F.col("row") > 1))
    return rows.select("file", F.substring_index("line", "\t", 1).alias("plasmid"), F.substring_index("line", "\t", -1).try_cast("double").alias("proportion"))


def pairs(sections: DataFrame) -> DataFrame:
    """(file, reference, prediction, recall, precision)."""
    found = lambda i: F.regexp_extract("line", r"^(\S+) <-> (\S+) \(([0-9.]+) resp\. ([0-9.]+)\)", i)
    rows = sections.filter("section = 'pairs'").select("file", found(1).alias("reference"), found(2).alias("prediction"), found(3).try_cast("double").alias("recall"), found(4).try_cast("double").alias("precision"))
    return rows.filter("reference <> ''")


def summary(sections: DataFrame) -> DataFrame:
    """(file, score, value) under the names recall, precision, overall."""
    name = F.substring_index("line", ":", 1)
    # Other names of the scores.
    for old, new in (("score_ref_coverage", "recall"), ("score_pred_coverage", "precision"), ("overall_score", "overall"), ("f1_score", "overall")):
        name = F.when(name == old, new).otherwise(name)
    return sections.filter("section = 'summary'").select("file", name.alias("score"), F.trim(F.substring_index("line", ":", -1)).try_cast("double").alias("value"))


def load_scores(sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References (best and union recall), predictions (best and union precision) and pairs of each file.

    References of a file without predictions score 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    best_r = coverage(sections, "ref_by_pred").groupBy("file", F.col("column_id").alias("plasmid")).agg(F.max("proportion").alias("best_recall"))
    best_p = coverage(sections, "pred_by_ref").groupBy("file", F.col("column_id").alias("plasmid")).agg(F.max("proportion").alias("best_precision"))
    refs = plasmids(sections, "references").join(best_r, ["file", "plasmid"], "left").join(totals(sections, "ref_by_all").withColumnRenamed("proportion", "union_recall"), ["file", "plasmid"], "left")
    preds = plasmids(sections, "predictions").join(best_p, ["file", "plasmid"], "left").join(totals(sections, "pred_by_all").withColumnRenamed("proportion", "union_precision"), ["file", "plasmid"], "left")
    return refs.select("file", "plasmid", "length", zero("best_recall"), zero("union_recall")), preds.select("file", "plasmid", "length", zero("best_precision"), zero("union_precision")), pairs(sections)


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(file, metric, tool, value): a report with a row for each metric and a column for each assembly; values as text."""
    rows = spark.read.text(path, wholetext=True).select(file_label().alias("file"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row", "line"))
    rows = rows.withColumn("cells", F.split("line", "\t"))
    head = rows.filter("row = 0").select("file", F.col("cells").alias("tools"))
    body = rows.filter("row > 0").select("file", F.trim(F.regexp_replace(F.element_at("cells", 1), "^ *# *", "")).alias("metric"), F.posexplode("cells").alias("i", "value")).filter("i > 0")
    return body.join(head, "file").select("file", "metric", F.try_element_at("tools", F.col("i") + 1).alias("tool"), "value")


def quality_of(report: DataFrame, files: DataFrame, tool: str, metrics: list[str]) -> DataFrame:
    """(file, a column for each metric, ``missing``): zeros where a file lacks the tool or is absent."""
    wide = report.filter(F.col("tool") == tool).groupBy("file").agg(*[F.max(F.when(F.col("metric") == m, F.col("value").try_cast("double"))).alias(m) for m in metrics])
    joined = files.select("file").distinct().join(wide.withColumn("there", F.lit(True)), "file", "left")
    return joined.select("file", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics], F.col("there").isNull().alias("missing"))


def section_totals(sections: DataFrame) -> DataFrame:
    """(file, section, n, length): number and total length of the listed sequences of each section that lists any."""
    rows = [plasmids(sections, name).withColumn("section", F.lit(name)) for name in ("chromosomes", "references", "predictions")]
    return union_all(*rows).groupBy("file", "section").agg(F.count("*").alias("n"), F.sum("length").cast("bigint").alias("length"))


def histogram(report: DataFrame, metrics: list[str]) -> DataFrame:
    """(tool, metric, value, n): in how many files a metric has a value, absent ones left out."""
    rows = report.filter(F.col("metric").isin(metrics)).select("tool", "metric", F.col("value").try_cast("int").alias("value")).filter("value is not null")
    return rows.groupBy("tool", "metric", "value").agg(F.count("*").alias("n"))


def report_lines(refs: DataFrame, preds: DataFrame, covers: DataFrame, by: list[str]) -> DataFrame:
    """by, ``value``: the text of one report for each group of predictions; references and predictions are those of one sample and tool.

    refs: by, plasmid, length, union_recall; preds: by, plasmid, length, union_precision; covers: by, reference,
    prediction, recall, precision of pairs with any overlap. The matrices have a column for each plasmid of such a pair.
    """
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.format_string("%.6f", F.coalesce(c, F.lit(0.0)))
    told = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x.text), "\n")
    name = lambda c: F.col(c).alias("key")

    def listed(df: DataFrame, score: str, out: str) -> DataFrame:
        rows = df.select(*by, name("plasmid"), line("\t", F.col("plasmid"), ": ", F.col("length").cast("string"), " nt").alias("text"), line(F.col("plasmid"), "\t", number(F.col(score))).alias("total"))
        totals = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "total"))), lambda x: x.total), "\n")
        return rows.groupBy(*by).agg(F.count("*").alias(f"n_{out}"), told().alias(f"{out}_list"), totals.alias(f"{out}_totals"))

    def matrix(rows: str, columns: str, score: str, out: str) -> DataFrame:
        cells = covers.groupBy(*by, F.col(rows).alias("row"), F.col(columns).alias("column")).agg(F.max(score).alias("cell"))
        heads = cells.groupBy(*by).agg(F.array_sort(F.collect_set("column")).alias("columns"))
        each = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("cells")).join(heads, by)
        body = F.concat("row", F.lit("\t"), F.array_join(F.transform("columns", lambda c: number(F.try_element_at("cells", c))), "\t"))
        text = each.select(*by, name("row"), body.alias("text")).groupBy(*by).agg(told().alias("body"))
        return heads.join(text, by).select(*by, F.concat(F.lit("\t"), F.array_join("columns", "\t"), F.lit("\n"), "body").alias(out))

    pairs_ = covers.select(*by, F.concat("reference", F.lit("\t"), "prediction").alias("key"), line(F.col("reference"), " <-> ", F.col("prediction"), " (", number(F.col("recall")), " resp. ", number(F.col("precision")), ")").alias("text"))
    both = listed(refs, "union_recall", "ref").join(listed(preds, "union_precision", "pred"), by)
    for more in (matrix("prediction", "reference", "recall", "by_pred"), matrix("reference", "prediction", "precision", "by_ref"), pairs_.groupBy(*by).agg(told().alias("pair_list"))):
        both = both.join(more, by, "left")
    share = lambda df, score, out: df.groupBy(*by).agg(F.try_divide(F.sum(F.col("length") * F.coalesce(score, F.lit(0.0))), F.sum("length")).alias(out))
    both = both.join(share(refs, "union_recall", "r"), by).join(share(preds, "union_precision", "p"), by)
    f = F.when(F.col("r") + F.col("p") > 0, 2 * F.col("r") * F.col("p") / (F.col("r") + F.col("p"))).otherwise(0.0)
    head = list(SECTIONS)
    n = lambda c: F.col(c).cast("string")
    return both.select(*by, F.concat_ws(
        "\n", F.lit(f"{head[0]}: 0"), line(f"{head[1]}: ", n("n_ref")), "ref_list", F.lit(""), F.lit("##### tool #####"), line(f"{head[2]}: ", n("n_pred")), "pred_list", F.lit(""),
        F.lit(head[3]), "by_pred", F.lit(""), F.lit(head[4]), "by_ref", F.lit(""), F.lit(f"{head[5]} is covered"), F.lit("plasmid\tproportion"), "pred_totals", F.lit(""),
        F.lit(f"{head[6]} is covered"), F.lit("plasmid\tproportion"), "ref_totals", F.lit(""), F.lit(head[7]), F.coalesce("pair_list", F.lit("none")), F.lit(""),
        F.lit(head[8]), line("recall: ", number(F.col("r"))), line("precision: ", number(F.col("p"))), line("f1_score: ", number(f)),
    ).alias("value"))


def quality_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, ``value``: one report for each group from (by, metric, tool, value): a line for each metric, a column for each tool."""
    tools = rows.groupBy(*by).agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    each = rows.groupBy(*by, "metric").agg(F.map_from_entries(F.collect_list(F.struct("tool", "value"))).alias("cells")).join(tools, by)
    line = each.select(*by, "tools", "metric", F.concat("metric", F.lit("\t"), F.array_join(F.transform("tools", lambda t: F.coalesce(F.try_element_at("cells", t), F.lit("-"))), "\t")).alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", "text"))), lambda x: x.text), "\n")
    return line.groupBy(*by, "tools").agg(body.alias("body")).select(*by, F.concat(F.lit("Assembly\t"), F.array_join("tools", "\t"), F.lit("\n"), "body").alias("value"))
