"""Problem 1: overlapping, nested and gapped intervals per entity, by a sweep line.

An interval gives a plus event at its first position and a minus event behind its last. The events of one position are
netted, a prefix sum over the positions gives the number of open intervals, and the places where that number leaves or
reaches zero bound the covered periods and the gaps.

Entities of up to ``hot_rows`` intervals are swept as one sorted group after one shuffle by entity. Larger entities
are swept in blocks of ``block`` positions: their events are netted before
the shuffle, a block holds at most ``block`` positions however many rows the entity has, and what is open at a block's
start is a prefix sum over the entity's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringweave.session import Scratch

#: The keys of up to so many hot entities are sent to every task; more are joined.
MOST_SENT = 100_000


def _named(keys: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def _events(df: DataFrame, keys: list[str], sides: int) -> DataFrame:
    """One row for each event; positions are BIGINT, so that the end of an interval at the last INT has a successor."""
    events = [
        F.struct(F.lit(i).alias("__side"), F.col(f"__{at}{i}").alias("__pos"), F.lit(delta).cast("bigint").alias("__delta"))
        for i in range(sides)
        for at, delta in (("from", 1), ("past", -1))
    ]
    return df.select(*keys, F.inline(F.array(*events))).filter("__pos is not null")


def _kind(open_now: str) -> Column:
    return F.when(F.col(open_now) > 0, F.lit("period")).otherwise(F.lit("gap"))


def _sweep_whole(df: DataFrame, keys: list[str], sides: int) -> DataFrame:
    """Each side of an entity is one sorted group."""
    group = [*keys, "__side"]
    w = Window.partitionBy(*group).orderBy("__pos")
    # Every later step is clustered by a superset of the keys, so this is the only shuffle.
    net = _events(df.repartition(*keys), keys, sides).groupBy(*group, "__pos").agg(F.sum("__delta").alias("__delta"))
    bounds = (
        net.withColumn("__open", F.sum("__delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("__open") == 0) != (F.col("__open") == F.col("__delta")))
    )
    return (
        bounds.withColumn("__next", F.lead("__pos").over(w))
        .filter("__next is not null")
        .select(*group, _kind("__open").alias("kind"), F.col("__pos").alias("pos_from"), (F.col("__next") - 1).alias("pos_to"))
    )


def _sweep_blocks(df: DataFrame, keys: list[str], sides: int, block: int, scratch: Scratch) -> DataFrame:
    """Each block of an entity is one sorted group; what is open before it, and the stretches that leave it, come from
    one row for each block."""
    group = [*keys, "__side"]
    net = (
        _events(df, keys, sides)
        .withColumn("__block", F.floor(F.col("__pos") / F.lit(block)))
        .groupBy(*group, "__block", "__pos")
        .agg(F.sum("__delta").alias("__delta"))
        .filter("__delta != 0")
    )
    net = scratch.write(net, "hot_events")
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        net.groupBy(*group, "__block").agg(F.sum("__delta").alias("__sum"))
        .select(*[F.col(c).alias(f"__c{c}") for c in (*group, "__block")], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    )
    w = Window.partitionBy(*group, "__block").orderBy("__pos")
    inside = (
        net.join(carried, [F.col(c).eqNullSafe(F.col(f"__c{c}")) for c in (*group, "__block")])
        .withColumn("__open", F.col("__carried") + F.sum("__delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("__open") == 0) != (F.col("__open") == F.col("__delta")))
        .withColumn("__next", F.lead("__pos").over(w))
    )
    inside = scratch.write(inside.select(*group, "__block", "__pos", "__open", "__next"), "hot_bounds")
    whole = inside.filter("__next is not null").select(
        *group, _kind("__open").alias("kind"), F.col("__pos").alias("pos_from"), (F.col("__next") - 1).alias("pos_to")
    )
    edges = inside.groupBy(*group, "__block").agg(
        F.min("__pos").alias("__first"), F.max("__pos").alias("__last"), F.max_by("__open", "__pos").alias("__open")
    )
    leaving = (
        edges.withColumn("__next", F.lead("__first").over(Window.partitionBy(*group).orderBy("__block")))
        .filter("__next is not null")
        .select(*group, _kind("__open").alias("kind"), F.col("__last").alias("pos_from"), (F.col("__next") - 1).alias("pos_to"))
    )
    return whole.unionByName(leaving)


def periods_and_gaps(
    df: DataFrame, keys: list[str], ends: dict[str, tuple[str, str]], *, side: str = "side", hot_rows: int = 500_000, block: int = 65_536
) -> DataFrame:
    """Covered periods and the gaps between them, per entity and side.

    ends: for each side, by the name it gets in the result, the two columns with an interval's ends.
    Result: the key columns, ``side``, ``kind`` ('period' or 'gap'), ``pos_from``, ``pos_to`` BIGINT, both inclusive.

    - Reversed ends are swapped; stretches that touch without a free position are one period.
    - A row with a null end is left out on that side only; null keys are an entity like any other; repeated rows
      change nothing. No gap lies before the first or behind the last period. An empty table gives an empty result.
    - Other columns of df are ignored, whatever they are called.
    """
    names = _named(keys)
    columns = [F.col(k).alias(n) for k, n in zip(keys, names)]
    for i, (a, b) in enumerate(ends.values()):
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        columns.append(F.when(known, F.least(a, b).cast("bigint")).alias(f"__from{i}"))
        columns.append(F.when(known, F.greatest(a, b).cast("bigint") + 1).alias(f"__past{i}"))
    rows = df.select(*columns)
    scratch = Scratch(df.sparkSession, "sweep")
    # Counted by entity with map-side combining.
    hot = scratch.write(rows.groupBy(*names).count().filter(F.col("count") > hot_rows).select(*[F.col(n).alias(f"__h{n}") for n in names]), "hot")
    n_hot = hot.count()
    if not n_hot:
        found = _sweep_whole(rows, names, len(ends))
    else:
        same = [F.col(n).eqNullSafe(F.col(f"__h{n}")) for n in names]
        hot = F.broadcast(hot) if n_hot <= MOST_SENT else hot
        found = _sweep_whole(rows.join(hot, same, "left_anti"), names, len(ends)).unionByName(
            _sweep_blocks(rows.join(hot, same, "left_semi"), names, len(ends), block, scratch)
        )
    label = F.element_at(F.array(*[F.lit(s) for s in ends]), F.col("__side") + 1)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], label.alias(side), "kind", "pos_from", "pos_to")


def pair_stretches(matches: DataFrame, **how: int) -> DataFrame:
    """Periods and gaps of each pair (qseqid, sseqid) on the query ('q') and on the subject ('s')."""
    found = periods_and_gaps(matches, ["qseqid", "sseqid"], {"q": ("qstart", "qend"), "s": ("sstart", "send")}, **how)
    return found.withColumns({c: F.col(c).cast("int") for c in ("pos_from", "pos_to")})
