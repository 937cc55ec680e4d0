"""Problem 2: one group for all records linked directly or through others, by contracting trees and chains first.

Each round strips the vertices of degree one and splices vertices of degree two out of their chains (list ranking by
independent sets: of two neighbouring candidates the one with the higher priority goes, so a chain of any length
shrinks by a constant share a round). A removed vertex keeps a pointer to a neighbour that stayed. What no longer
shrinks is the core, which large-star and small-star steps solve. A removed vertex points to one that was removed in a
later round or not at all, so that pointers are followed by doubling, in as many steps as the rounds have binary digits, and
then give the labels back.

Skew: degrees and smallest neighbours are aggregated with map-side combining; whatever is compared between neighbours
is grouped by the pair, never by one vertex, so a vertex that holds a third of all links is never a group. The joins
that do look up a hub have the hub once on the other side; adaptive execution splits their large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.operators.graph import both_ways, star_labels
from ringweave.session import Scratch, union_all


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _removable(edges: DataFrame, seed: int) -> DataFrame:
    """(v, lo, hi): an independent set of vertices of degree one (lo = hi) and two, with their neighbours."""
    low = (
        both_ways(edges).groupBy("v").agg(F.count("*").alias("degree"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        .filter("degree <= 2")
        # Vertices of degree one come first; a new hash each round breaks ties along chains.
        .withColumn("rank", F.struct(F.col("degree"), F.xxhash64("v", F.lit(seed)).alias("h"), F.col("v")))
    )
    claims = low.select("v", "rank", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("u"))
    blocked = (
        claims.select(*_pair("v", "u"), "rank").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("rank").alias("loser"))
        .filter("n = 2").select(F.col("loser.v").alias("v")).distinct()
    )
    return low.join(blocked, "v", "left_anti").select("v", "lo", "hi")


def _contracted(edges: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, int, DataFrame, int]:
    """Removed vertices (v, p) and the edges (a, b) that stay or are spliced, written together, and the numbers of either."""
    gone = _removable(edges, seed)
    cut = gone.select(F.explode(F.array("lo", "hi")).alias("u"), "v").select(*_pair("v", "u"))
    spliced = gone.filter("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    stay = edges.join(cut, ["a", "b"], "left_anti").unionByName(spliced).distinct()
    both = gone.select(F.lit(True).alias("gone"), F.col("v").alias("x"), F.col("lo").alias("y"))
    both = scratch.write(both.unionByName(stay.select(F.lit(False).alias("gone"), F.col("a").alias("x"), F.col("b").alias("y"))), f"round{seed}")
    n_gone, n_edges = both.agg(F.count_if("gone"), F.count_if(~F.col("gone"))).first()
    return both.filter("gone").select(F.col("x").alias("v"), F.col("y").alias("p")), n_gone, both.filter("not gone").select(F.col("x").alias("a"), F.col("y").alias("b")), n_edges


def _followed(pointers: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """(v, p): the vertex that each removed vertex's pointers end at, which was never removed."""
    for step in range(max(rounds - 1, 0).bit_length()):
        ahead = pointers.select(F.col("v").alias("p"), F.col("p").alias("next"))
        pointers = scratch.write(pointers.join(ahead, "p", "left").select("v", F.coalesce("next", "p").alias("p")), f"pointers{step}")
    return pointers


def linked_groups(pairs: DataFrame, left: str, right: str, *, seq: str = "seq_id", least_share: float = 0.05) -> DataFrame:
    """One row for each record that has a link: ``seq_id`` and ``group_id``, the smallest record of its group.

    - Links have no direction; repeated links and links of a record with itself change nothing, and a record that has
      only links with itself does not appear. Links with a null end are left out. No links give an empty result.
    - Records of any orderable type; strings are compared by code point. Other columns are ignored.

    least_share: below this share of vertices removed in a round, contraction ends and the core is solved.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    links = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y").select(*_pair("x", "y")).distinct()
    edges = scratch.write(links, "edges")
    removed: list[DataFrame] = []
    while True:
        gone, n_gone, edges, n_edges = _contracted(edges, len(removed), scratch)
        if n_gone:
            removed.append(gone)
        if not n_edges or n_gone < least_share * n_edges:
            break
    # Vertices that lost their last link without being removed are roots and label themselves.
    core = star_labels(edges, scratch) if n_edges else None
    if not removed:
        known = core
    else:
        pointers = _followed(union_all(*removed), len(removed), scratch)
        ends = pointers.unionByName(pointers.select("p", "p").distinct().toDF("v", "p"))
        if core is None:
            known = ends.select("v", F.col("p").alias("label"))
        else:
            known = ends.join(core.select(F.col("v").alias("p"), "label"), "p", "left").select("v", F.coalesce("label", "p").alias("label")).unionByName(core).distinct()
    if known is None:
        return links.select(F.col("a").alias(seq), F.col("a").alias("group_id"))
    known = scratch.write(known, "labels")
    # A label is any record of the group; the smallest one is found with map-side combining and looked up by label.
    smallest = known.groupBy("label").agg(F.min("v").alias("group_id"))
    return known.join(smallest, "label").select(F.col("v").alias(seq), "group_id")
