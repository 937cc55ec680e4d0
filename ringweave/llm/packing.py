"""Problem 6: texts into containers of fixed capacity with little unused space, by bulk-synchronous best fit.

Sizes are numbers of tokens, so texts of one size are interchangeable: range-sorted by size they are kept as runs (size,
first rank, count), and containers with equal room as runs (room, first container, count). A round range-sorts items and
gaps together by size and sweeps each range upwards: a gap takes the largest items below it that are not taken yet, the
lowest ranks first where several gaps compete for one size; rooms are updated, and what did not match meets in the next
sweep over wider ranges. When no gap holds the smallest item any more, as many containers are opened as the tokens left
would fill. The rounds' matches say which ranks of a size went where, and the texts, ranked within their size by two
levels of counting, look their container up. There are at most ``capacity`` runs of items, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringweave.session import Scratch, union_all

# Fixed value: the pattern by which this vocabulary's texts are split before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts in which the texts of one size are counted and ranked, so that no size is one sorted group.
RANK_PARTS = 512
#: Runs of a range that one task sweeps in a round's first step; with 2,048 sizes, eight ranges of items.
SWEEP_RUNS = 256

STATE = "kind string, value bigint, first bigint, n bigint, bin bigint, per bigint"


def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc: str, text: str, vocabulary: str) -> DataFrame:
    """(doc, tokens) of each text that is neither null nor empty. vocabulary: path of a rank file all executors have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc", "tokens"])

    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null and length(text) > 0")
    return rows.mapInArrow(count, "doc bigint, tokens bigint")


def _ranked(items: DataFrame) -> DataFrame:
    """Items with their rank within their size, from 0."""
    items = items.withColumn("part", F.pmod(F.xxhash64("doc", "piece"), F.lit(RANK_PARTS)))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc", "piece"))
    return items.withColumn("within", within).join(offsets, ["size", "part"]).select("doc", "piece", "size", (F.col("offset") + F.col("within") - 1).alias("rank"))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of items and gaps in ascending order, items before gaps of the same size."""
    items: list[list[int]] = []
    out: list[tuple] = []
    for frame in frames:
        for kind, value, first, n, bin_, _ in frame.itertuples(index=False):
            if kind == "item":
                items.append([value, first, n])
                continue
            while n and items:
                size, at, count = top = items[-1]
                # Several items of one size go into a gap at once where the room and the number of items allow it.
                per = max(1, min(value // size, count // n))
                used = min(n, count // per)
                out.append(("match", size, at, used, bin_, per))
                if value > size * per:
                    out.append(("gap", value - size * per, 0, used, bin_, 0))
                top[1:] = at + used * per, count - used * per
                if not top[2]:
                    items.pop()
                bin_, n = bin_ + used, n - used
            if n:
                out.append(("gap", value, 0, n, bin_, 0))
    out += [("item", size, at, count, 0, 0) for size, at, count in items]
    if out:
        yield pd.DataFrame(out, columns=["kind", "value", "first", "n", "bin", "per"])


def _matches(runs: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(value, first, n, bin, per): ranks first .. first + n * per - 1 of size value fill n containers from bin on."""
    spark = runs.sparkSession
    state = scratch.write(runs.select(F.lit("item").alias("kind"), F.col("size").alias("value"), F.lit(0).cast("bigint").alias("first"), F.col("count").alias("n"), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("per")), "runs")
    found, opened, step = [], 0, 0
    summary = [
        F.count("*").alias("runs"), F.max(F.when(F.col("kind") == "gap", F.col("value"))).alias("room"),
        F.min(F.when(F.col("kind") == "item", F.col("value"))).alias("least"), F.sum(F.when(F.col("kind") == "item", F.col("value") * F.col("n"))).alias("left"),
    ]
    while True:
        now = state.agg(*summary).first()
        if not now["left"]:
            return union_all(*found) if found else state.filter("kind = 'match'")
        if now["room"] is None or now["room"] < now["least"]:
            more = -(-now["left"] // capacity)
            state = state.unionByName(spark.createDataFrame([("gap", capacity, 0, more, opened, 0)], STATE))
            opened += more
        parts = -(-now["runs"] // SWEEP_RUNS)
        while True:  # wider and wider ranges, the last of which holds all runs that are left
            ranges = state.repartitionByRange(parts, "value") if parts > 1 else state.coalesce(1)
            swept = scratch.write(ranges.sortWithinPartitions("value", F.desc("kind")).mapInPandas(_sweep, STATE), f"round{step}")
            found.append(swept.filter("kind = 'match'"))
            state, step = swept.filter("kind <> 'match'"), step + 1
            if parts == 1:
                break
            parts = -(-parts // 8)


def pack(documents: DataFrame, doc: str, text: str, *, capacity: int = 2048, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id``, ``piece``, ``token_from``, ``n_tokens``, ``bin``: where each text, or each piece of a longer one, goes.

    - Texts of up to ``capacity`` tokens are one piece. Longer ones are cut every ``capacity`` tokens, counted from the
      start; their full pieces fill a container each, and the rest is an item like any other.
    - Null and empty texts and null ids are left out; an id that occurs in several rows stands for as many texts, which
      are told apart by nothing but their rows. Containers are numbered from 0. No text gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    counts = token_counts(documents, doc, text, vocabulary)
    c = F.lit(capacity).cast("bigint")
    pieces = counts.select("doc", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / c))).alias("piece"))
    items = scratch.write(pieces.select("doc", "piece", F.least(c, F.col("tokens") - F.col("piece") * c).alias("size")), "items")
    matches = _matches(items.groupBy("size").count(), capacity, scratch)
    # Bounded by the capacity (runs of items) and the rounds, not by the number of texts.
    fits = F.broadcast(matches.select(F.col("value").alias("m_size"), "first", "n", "bin", "per"))
    ranked = _ranked(items)
    placed = ranked.join(fits, (F.col("size") == F.col("m_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n") * F.col("per")))
    return placed.select(
        F.col("doc").alias("doc_id"), "piece", (F.col("piece") * c).alias("token_from"), F.col("size").alias("n_tokens"),
        (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("bin"),
    )
