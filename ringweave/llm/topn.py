"""Problem 4: the N items with the highest scores within every group, by a secondary sort.

Rows are hash-partitioned by group, sorted within partitions by group, score and identifier, and streamed in Arrow
batches that let the first N rows of each group pass; no group is ever held. A group of any size is first thinned where
it lies: finding an item's best score spreads a group over all partitions, by group and item, and there the same sort
and stream leave N rows of it in each partition. So at most N rows of a group from each partition meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the group at the end of the batch before, and how many of its rows went by
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            index = code.indices.to_numpy(zero_copy_only=False)
            new = np.append(True, index[1:] != index[:-1])
            starts = np.flatnonzero(new)
            rank = np.arange(len(index)) - np.repeat(starts, np.diff(np.append(starts, len(index))))
            if batch.column(0)[0].as_py() == last:
                rank[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = batch.column(0)[-1].as_py(), int(rank[-1]) + 1
            keep = rank < n
            out = batch.filter(pa.array(keep))
            if ranked:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array((rank[keep] + 1).astype(np.int32))], names=[*out.schema.names, "place"])
            yield out

    return run


def top_items(df: DataFrame, group: str, item: str, score: str, n: int = 5, *, rank: str = "item_rank") -> DataFrame:
    """``group``, ``rank`` (1 to n), ``item``: the n items with the highest scores of each group.

    - An item's score is its highest non-null score in the group; items without one are left out, as are rows with a
      null group or item. NaN counts as the largest number. Equal scores are ordered by item, ascending by code point.
    - Groups with fewer items have fewer rows; repeated rows change nothing; an empty table gives an empty result.
    - Other columns are ignored, whatever they are called.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("x")).filter("g is not null and i is not null and x is not null")
    best = rows.groupBy("g", "i").agg(F.max("x").alias("x"))
    order = ["g", F.desc("x"), "i"]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in best.schema)
    thinned = best.sortWithinPartitions(*order).mapInArrow(_first_n(n, False), shape)
    ranked = thinned.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_n(n, True), f"{shape}, place int")
    return ranked.select(F.col("g").alias(group), F.col("place").alias(rank), F.col("i").alias(item))
