"""Length-weighted statistics per group, and running totals that no group is too large for.

A running total is taken in two steps: over the sums of blocks of neighbouring values, of which there are few, and
inside each block. So no group, however many rows it has, is one sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_of(value: str, weight: str) -> Column:
    """Weighted mean; 0 for an empty group, as a total weight of 0 counts as 1."""
    total = F.sum(weight)
    return F.sum(F.col(value) * F.col(weight)) / F.when(total > 0, total).otherwise(F.lit(1))


def deviations(df: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """keys, <value>_mean, <value>_sd: weighted means and population deviations in one pass over the moments."""
    w = F.col(weight)
    sums = df.groupBy(*keys).agg(
        F.sum(w).alias("__w"), *[f(F.col(v)).alias(f"__{n}_{v}") for v in values for n, f in (("s", lambda x: F.sum(x * w)), ("q", lambda x: F.sum(x * x * w)))]
    )
    out = []
    for v in values:
        mean = F.col(f"__s_{v}") / F.col("__w")
        out += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(F.col(f"__q_{v}") / F.col("__w") - mean * mean, F.lit(0.0))).alias(f"{v}_sd")]
    return sums.select(*keys, *out)


def _block(value: str) -> Column:
    """Blocks of about a thousandth of a value's size, in the values' order: a few thousand for each sign and power of ten."""
    x = F.col(value).cast("double")
    size = F.abs(x)
    return F.coalesce(F.signum(x) * (F.floor(F.log2(F.when(size > 0, size)) * 1024) + 2_000_000), F.lit(0.0))


def running_totals(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, value, ``upto``: for each different value the total weight of the values up to it, and ``total``."""
    net = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w")).withColumn("__block", _block(value))
    blocks = net.groupBy(*keys, "__block").agg(F.sum("__w").alias("__b"))
    over = Window.partitionBy(*keys)
    before = blocks.select(
        *keys, "__block", (F.sum("__b").over(over.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b")).alias("__before"), F.sum("__b").over(over).alias("total")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("__in", F.sum("__w").over(inside)).join(before, [*keys, "__block"]).select(*keys, value, (F.col("__before") + F.col("__in")).alias("upto"), "total")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """keys, name: the value at half the total weight, interpolated between the ranks around it; integer weights.

    Rows with a null value or weight are left out; groups without any others do not appear.
    """
    known = df.select(*keys, value, weight).filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    totals = running_totals(known, keys, value, weight)
    rank = F.floor(F.col("total") / 2)
    at = totals.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") >= rank, F.col(value))).alias("__left"),
        F.min(F.when(F.col("upto") >= rank + 1, F.col(value))).alias("__right"),
        F.first(F.col("total") / 2 - rank).alias("__part"),
    )
    return at.select(*keys, (F.col("__left") + (F.coalesce("__right", "__left") - F.col("__left")) * F.col("__part")).alias(name))


def n50(df: DataFrame, keys: list[str], length: str, name: str = "n50") -> DataFrame:
    """keys, name: the smallest length up to which the ascending lengths add up to at least half of their total."""
    totals = running_totals(df.filter(F.col(length).isNotNull()), keys, length, length)
    return totals.filter(F.col("upto") >= F.col("total") / 2).groupBy(*keys).agg(F.min(length).alias(name))


def places(df: DataFrame, keys: list[str], value: str, *ties: Column, name: str = "place") -> DataFrame:
    """Rows with ``name``: their place within the keys, 1 first, by ascending value and then by the given orders."""
    rows = df.withColumn("__block", _block(value))
    blocks = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(*keys, "__block", (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(value, *ties))
    return rows.withColumn("__in", inside).join(blocks, [*keys, "__block"]).withColumn(name, (F.col("__before") + F.col("__in")).cast("int")).drop("__block", "__in", "__before")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: the value below which that share of the rows lies, interpolated; nulls are left out."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.lit(1).alias("__one"))
    totals = running_totals(known, keys, "__v", "__one")
    at = lambda share, more: F.min(F.when(F.col("upto") >= F.floor((F.col("total") - 1) * share) + 1 + more, F.col("__v")))
    ends = [x.alias(f"__{side}{i}") for i, p in enumerate(shares.values()) for side, x in (("lo", at(p, 0)), ("hi", at(p, 1)))]
    found = totals.groupBy(*keys).agg(F.first("total").alias("__n"), *ends)
    part = lambda p: (F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p)
    return found.select(*keys, *[(F.col(f"__lo{i}") + (F.coalesce(f"__hi{i}", f"__lo{i}") - F.col(f"__lo{i}")) * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, minimum, mean, sd (of the sample), q25, median, q75 (interpolated), maximum."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(v).alias("maximum"))
    cuts = quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(cuts, keys, "left").select(*keys, "minimum", "mean", "sd", "q25", "median", "q75", "maximum")
