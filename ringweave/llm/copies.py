"""Problem 5: records that are the same but for their formatting, by recursive radix partitioning on canonical bytes.

A record's canonical bytes are the letters of its sequence in upper case and its words in lower case and sorted order.
Records are put into buckets by the first bytes. A bucket that is larger than a task should hold is split by the bytes
behind those that all its records have in common, again and again until each part fits; a bucket of one and the same
value, which no byte can split, is split by record number instead. Each bucket then goes through a trie of its own whose
terminals count the copies and keep the smallest number; the parts of a value that was split by number are joined by
their terminals, of which there is one for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ringweave.session import Scratch, union_all

#: The keys of up to so many buckets that are split in one round are sent to every task; more are joined.
MOST_SENT = 100_000
#: Bytes by which a bucket is split in one round, and bytes of a trie's edge.
RADIX, EDGE = 12, 64


def canonical(label: str, seq: str) -> Column:
    """Letters of the sequence, a blank, the label's words in order; null if the sequence has no letter."""
    letters = F.upper(F.regexp_replace(F.col(seq), "[^A-Za-z]+", ""))
    words = F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(F.col(label), F.lit("")), F.lit("([A-Za-z0-9]+)")), F.lower))
    return F.when(F.length(letters) > 0, F.concat(letters, F.lit(" "), F.array_join(words, " ")))


@F.pandas_udf(IntegerType())
def _common(low: pd.Series, high: pd.Series) -> pd.Series:
    """Number of leading bytes that two values, and so all between them in order, have in common."""

    def count(a: str, b: str) -> int:
        at, most = 0, min(len(a), len(b))
        step = most
        while step:  # doubling back from the far end, so that long prefixes are compared in whole slices
            if a[at : at + step] == b[at : at + step]:
                at += step
            step = min(step // 2, most - at) if step > 1 else 0
        while at < most and a[at] == b[at]:
            at += 1
        return at

    return pd.Series([count(a, b) for a, b in zip(low, high)], dtype="int32")


class Trie:
    """Values with a shared beginning share a path; a value's terminal is [value, smallest number, numbers]."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, value: str, number: int) -> None:
        node, at = self.root, 0
        while True:
            edge = value[at : at + EDGE]
            child = node.get(edge)
            at += EDGE
            if child is None:
                node[edge] = [value, number, {number}]
                return
            if isinstance(child, list):
                if child[0] == value:
                    child[1] = min(child[1], number)
                    child[2].add(number)
                    return
                child = node[edge] = {child[0][at : at + EDGE]: child}
            node = child

    def terminals(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            for child in todo.pop().values():
                if isinstance(child, list):
                    yield child
                else:
                    todo.append(child)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, split, num, value) sorted by bucket -> (bucket, split, num, rep)."""
    now, split, trie = None, False, Trie()

    def counted() -> pa.RecordBatch:
        found = [(n, t[1]) for t in trie.terminals() for n in t[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array([now] * len(found), pa.string()), pa.array([split] * len(found), pa.bool_()), pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())],
            names=["bucket", "split", "num", "rep"],
        )

    for batch in batches:
        for bucket, cut, number, value in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if now is not None:
                    yield counted()
                now, split, trie = bucket, cut, Trie()
            trie.add(value, number)
    if now is not None:
        yield counted()


def _buckets(rows: DataFrame, bucket_bytes: int, scratch: Scratch) -> DataFrame:
    """(bucket, split, num, value): every row in a bucket that fits; split: the bucket is one of several of one value."""
    settled, level = [], 0
    rows = rows.withColumn("bucket", F.substring("value", 1, RADIX))
    while True:
        sizes = rows.groupBy("bucket").agg(F.sum(F.length("value")).alias("bytes"))
        large = scratch.write(sizes.filter(F.col("bytes") > bucket_bytes).select("bucket"), f"large{level}")
        n_large = large.count()
        if not n_large:
            return union_all(rows.select("bucket", F.lit(False).alias("split"), "num", "value"), *settled)
        send = F.broadcast if n_large <= MOST_SENT else lambda df: df
        settled.append(rows.join(send(large), "bucket", "left_anti").select("bucket", F.lit(False).alias("split"), "num", "value"))
        rest = rows.join(send(large), "bucket", "left_semi")
        ends = rest.groupBy("bucket").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.length("value")).alias("bytes"))
        ends = ends.select("bucket", F.when(F.col("low") < F.col("high"), _common("low", "high")).alias("common"), F.ceil(F.col("bytes") / F.lit(bucket_bytes)).alias("parts"))
        ends = scratch.write(ends, f"ends{level}")
        rest = scratch.write(rest.join(send(ends), "bucket"), f"rest{level}")
        same = rest.filter("common is null")
        part = F.pmod(F.xxhash64("num"), F.col("parts"))
        settled.append(same.select(F.concat("bucket", F.lit("\n"), part).alias("bucket"), F.lit(True).alias("split"), "num", "value"))
        rows = rest.filter("common is not null").select("num", "value", F.concat("bucket", F.lit("\t"), F.expr(f"substring(value, common + 1, {RADIX})")).alias("bucket"))
        level += 1


def copy_members(records: DataFrame, number: str, label: str, seq: str, *, bucket_bytes: int = 16_000_000) -> DataFrame:
    """(num, rep): each record and the smallest number among the records that are the same, itself included.

    - Records whose sequence is null or has no letter, and null numbers, are left out; a null label has no words. Rows
      that repeat a number count once. An empty table gives an empty result. Other columns are ignored.
    - Values are compared by all their bytes, of any length. bucket_bytes: what one trie may hold.
    """
    rows = records.select(F.col(number).cast("bigint").alias("num"), canonical(label, seq).alias("value")).filter("num is not null and value is not null")
    scratch = Scratch(records.sparkSession, "copies")
    buckets = _buckets(rows, bucket_bytes, scratch)
    counted = scratch.write(buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tries, "bucket string, split boolean, num bigint, rep bigint"), "counted")
    parts = counted.filter("split").withColumn("whole", F.substring_index("bucket", "\n", 1))
    # One terminal for each part of a value that was split.
    joined = parts.groupBy("whole").agg(F.min("rep").alias("least"))
    return counted.filter("not split").select("num", "rep").unionByName(parts.join(joined, "whole").select("num", F.col("least").alias("rep")))


def collapsed(records: DataFrame, number: str, label: str, seq: str, **how: int) -> DataFrame:
    """``ref_no``, ``n_copies``: the record that remains of each group, and how many records the group has."""
    return copy_members(records, number, label, seq, **how).groupBy(F.col("rep").alias("ref_no")).agg(F.count("*").alias("n_copies"))
