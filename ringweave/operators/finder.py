"""Growing plasmid candidates in assembly graphs, and what follows from them.

Growth is sequential: each candidate takes depth away from the segments it uses. But it never leaves a component of the
graph, so components, not samples, are the unit of work; only components with a seed are shuffled. Thresholds, seeds,
densities and everything behind growth (facts, subsets, classes, bins' order) are joins and aggregates.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringweave.functions.sequences import flip, gc_fraction, reverse_complement, step_score, suffix_prefix_overlap, wrapped
from ringweave.operators import graph as G
from ringweave.operators.sweep import periods_and_gaps
from ringweave.operators.weighted import deviations, mean_of, weighted_median
from ringweave.session import Scratch


@dataclass(frozen=True)
class Growth:
    """Limits, weights and ways of growth; the limits are the published ones."""

    max_score: float = float("inf")
    max_length: int = 1_750_000
    max_gc_diff: float = 0.15
    max_gap_nt: int = 2000
    max_gap_segments: int = 2
    by_segment: bool = False  # each segment once, with its whole depth; a step may close the ring
    roulette: int | None = None  # seed of a draw by depth among the allowed steps; one step, as published
    weights: tuple[float | None, float | None, float | None] = (1.0, 1.0, 1.0)  # depth, density, GC; None: the seeds' deviation
    use_median: bool = False  # a chain's depth is the median over its letters, not the mean
    fan_out: int = 1  # best steps taken at once; above 1 candidates branch and are collections, not chains; link-based only


MEMBERS = "sample_id int, component string, seed string, seed_place int, found int, pos int, member int, seg_name string, orientation string, depth double, score double, circular boolean"
FLIP = {"+": "-", "-": "+"}


class Chain:
    """A candidate under way: members from left to right, each [id, name, orientation, score, gap nt, gap segments]."""

    def __init__(self, seed: str, facts: dict, depths: dict, rules: Growth):
        self.facts, self.depths, self.rules, self.links = facts, depths, rules, set()
        # Sums over the members' letters; the occurrences of a segment share its depth, so it counts once.
        self.letters, self.depth_sum, self.gc_sum = 0, 0.0, 0.0
        self.weights = (facts[seed].w_depth, facts[seed].w_density, facts[seed].w_gc)
        self.members = [[0, seed, "+", self.weights[1] * (1 - facts[seed].density), 0, 0]]
        self.uses, self.closed, self.next_id = Counter([seed]), False, 1
        self.sides: dict[int, set[str]] = {0: set()}  # on which sides each member goes on
        self._count(seed, True)

    def _count(self, name: str, new: bool) -> None:
        fact = self.facts[name]
        self.letters += fact.length
        self.gc_sum += fact.gc * fact.length
        self.depth_sum += self.depths[name] * fact.length if new else 0.0

    def average(self, value) -> float:
        total = sum(self.facts[m[1]].length for m in self.members)
        return sum(value(m[1]) * self.facts[m[1]].length for m in self.members) / (total or 1)

    def depth(self, value) -> float:
        """Mean or median over the members' letters."""
        if not self.rules.use_median:
            return self.average(value)
        rows = sorted((value(m[1]), self.facts[m[1]].length) for m in self.members)
        half = sum(n for _, n in rows) / 2
        left = right = None
        upto = 0
        for v, n in rows:
            upto += n
            left = v if left is None and upto >= int(half) else left
            right = v if right is None and upto >= int(half) + 1 else right
        right = left if right is None else right
        return left + (right - left) * (half - int(half))

    @staticmethod
    def link(a: tuple, b: tuple) -> tuple:
        """A link and its mirror image are the same."""
        return min((a, b), ((b[0], FLIP[b[1]]), (a[0], FLIP[a[1]])))

    def ends(self) -> list[tuple]:
        """(side, member, member at the other end) where the candidate may go on."""
        if self.rules.fan_out == 1:
            return [("left", self.members[0], self.members[-1]), ("right", self.members[-1], self.members[0])]
        if len(self.members) == 1:
            return [(side, self.members[0], self.members[0]) for side in ("left", "right")]
        return [("right" if "left" in self.sides[m[0]] else "left", m, m) for m in self.members if len(self.sides[m[0]]) == 1]

    def steps(self, ways: dict, least_depth: float) -> list[tuple]:
        """Allowed continuations (score, order, side, end, (name, orientation), link, share), the best first."""
        rules, depths, found = self.rules, self.depths, []
        split = (lambda n, k: 1) if rules.by_segment else (lambda n, k: self.uses[n] + k)
        depth = self.depth(lambda n: depths[n] / split(n, 0)) if rules.use_median else self.depth_sum / (self.letters or 1)
        gc, room = self.gc_sum / (self.letters or 1), rules.max_length - self.letters
        if depth <= 0 or (self.closed and rules.by_segment):
            return []
        for side, end, far in self.ends():
            here = (end[1], end[2])
            for there in ways.get((side, *here), ()):
                name, fact = there[0], self.facts[there[0]]
                known = rules.by_segment and self.uses[name] > 0
                share = depths[name] / split(name, 1)
                link = self.link(there, here) if side == "left" else self.link(here, there)
                taken = name != far[1] if known else link in self.links
                near = end[4] + fact.length <= rules.max_gap_nt or end[5] < rules.max_gap_segments or fact.has_genes
                if taken or share < least_depth or abs(gc - fact.gc) > rules.max_gc_diff or not near or (0 if known else fact.length) > room:
                    continue
                score = step_score(share / depth, fact.density, gc - fact.gc, self.weights, abs)
                if score <= rules.max_score:
                    found.append((score, (end[0], side, *there), side, end, there, link, share))
        return sorted(found, key=lambda s: s[:2])

    def take(self, step) -> None:
        score, _, side, end, (name, orientation), link, _ = step
        fact = self.facts[name]
        if self.rules.by_segment and self.uses[name]:
            self.closed = True
            return
        gap = (0, 0) if fact.has_genes else (end[4] + fact.length, end[5] + 1)
        self.sides[end[0]].add(side)
        self.sides[self.next_id] = {"right" if side == "left" else "left"}
        self.members.insert(0 if side == "left" and self.rules.fan_out == 1 else len(self.members), [self.next_id, name, orientation, score, *gap])
        self.links.add(link)
        self._count(name, not self.uses[name])
        self.uses[name] += 1
        self.next_id += 1

    def close(self) -> None:
        """Ends that are the same segment the same way round are one; the worse copy goes, but never the seed."""
        first, last = self.members[0], self.members[-1]
        if not self.rules.by_segment and self.rules.fan_out == 1 and len(self.members) > 1 and first[1:3] == last[1:3]:
            drop_first = last[0] == 0 or (first[0] != 0 and first[3] >= last[3])
            self.members.pop(0 if drop_first else -1)
            self.uses[first[1]] -= 1
            self.closed = True


def _grow(rules: Growth):
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        facts = {r.seg_name: r for r in nodes.itertuples()}
        depths = dict(zip(nodes.seg_name, nodes.depth))
        ways: dict = {}
        for r in edges.sort_values(["src", "src_ori", "dst", "dst_ori"]).itertuples():
            ways.setdefault(("right", r.src, r.src_ori), []).append((r.dst, r.dst_ori))
            ways.setdefault(("left", r.dst, r.dst_ori), []).append((r.src, r.src_ori))
        seeds = list(nodes[nodes.place.notna()].sort_values("place").seg_name)
        draw = random.Random(f"{rules.roulette}:{nodes.sample_id.iloc[0]}:{nodes.component.iloc[0]}") if len(nodes) else None
        out, found = [], 0
        while seeds:
            chain = Chain(seeds[0], facts, depths, rules)
            least = facts[seeds[0]].least_depth
            while steps := chain.steps(ways, least):
                if rules.roulette is not None:
                    chain.take(draw.choices(steps, [s[-1] for s in steps])[0])
                    break
                for step in steps[: rules.fan_out]:
                    chain.take(step)
            chain.close()
            average = chain.depth(lambda n: depths[n] / chain.uses[n])
            shares = {n: min(depths[n] / k, average) for n, k in chain.uses.items() if k}
            for pos, (member, name, orientation, score, *_) in enumerate(chain.members):
                out.append((facts[seeds[0]].sample_id, facts[name].component, seeds[0], int(facts[seeds[0]].place), found, pos, member, name, orientation, shares[name], score, chain.closed))
            for _, name, *_ in chain.members:
                depths[name] -= shares[name]
            kept = [s for s in seeds if depths[s] > least]
            seeds, found = (kept if len(kept) < len(seeds) or average > 1e-9 else seeds[1:]), found + 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return run


def thresholds(segments: DataFrame, *, min_plasmid_depth: float | None = None, min_contig_depth: float | None = None) -> DataFrame:
    """(sample_id, plasmid_depth, least_depth): least depths of a candidate and of a segment.

    Where they are not given, 0.4 of the length-weighted median depth of the sample, and 0.75 of that.
    """
    normal = G.normal_segments(segments).filter("depth is not null and length is not null")
    found = weighted_median(normal, ["sample_id"], "depth", "length", "median")
    plasmid = 0.4 * F.col("median") if min_plasmid_depth is None else F.lit(float(min_plasmid_depth))
    found = found.select("sample_id", plasmid.alias("plasmid_depth"))
    return found.withColumn("least_depth", 0.75 * F.col("plasmid_depth") if min_contig_depth is None else F.lit(float(min_contig_depth)))


def grow(
    segments: DataFrame, links: DataFrame, densities: DataFrame, rules: Growth = Growth(), *, min_density: float = 0.1, max_seed_length: int = 500_000,
    min_plasmid_depth: float | None = None, min_contig_depth: float | None = None,
) -> DataFrame:
    """Members of all candidates: plasmid_no per sample in the order of discovery, place in the chain, depth taken.

    densities: (sample_id, seg_name, density, has_genes); segments that are missing there have none. Segments without a
    depth or length cannot take part. min_density: of a seed. Least depths: see ``thresholds``.
    """
    keys = ["sample_id", "seg_name"]
    normal = G.normal_segments(segments).filter("depth is not null and length is not null")
    least = thresholds(segments, min_plasmid_depth=min_plasmid_depth, min_contig_depth=min_contig_depth).select("sample_id", "least_depth")
    deep = normal.join(least, "sample_id").filter("depth >= least_depth").select(*keys)
    order = G.seeds(segments, links, densities.select(*keys, "density").join(deep, keys, "left_semi"), min_depth=0.0, min_density=min_density, max_length=max_seed_length)
    order = Scratch(segments.sparkSession, "growth").write(order, "seeds")
    given = dict(zip(("depth_diff", "gene_density", "gc_diff"), rules.weights))
    spread = seed_weights(order).select("sample_id", *[(F.col(c) if w is None else F.lit(float(w))).alias(n) for (c, w), n in zip(given.items(), ("w_depth", "w_density", "w_gc"))])
    nodes = (
        normal.join(densities, keys, "left").join(G.components(segments, links), keys).join(least, "sample_id").join(order.select(*keys, "place"), keys, "left").join(spread, "sample_id")
        .select(*keys, "component", "length", "depth", "gc", "least_depth", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("has_genes", F.lit(False)).alias("has_genes"), "place", "w_depth", "w_density", "w_gc")
    )
    nodes = Scratch(segments.sparkSession, "growth").write(nodes, "nodes")
    nodes = nodes.join(nodes.filter("place is not null").select("sample_id", "component").distinct(), ["sample_id", "component"], "left_semi")
    place = nodes.select(F.col("sample_id").alias("e_sample"), F.col("seg_name").alias("e_seg"), F.col("component").alias("e_component"))
    edges = G.edges(links).join(place, (F.col("sample_id") == F.col("e_sample")) & (F.col("src") == F.col("e_seg")))
    edges = edges.join(normal.select(F.col("sample_id").alias("d_sample"), F.col("seg_name").alias("d_seg")), (F.col("sample_id") == F.col("d_sample")) & (F.col("dst") == F.col("d_seg")), "left_semi")
    edges = edges.select("e_sample", "e_component", "src", "src_ori", "dst", "dst_ori").distinct()
    members = nodes.groupBy("sample_id", "component").cogroup(edges.groupBy("e_sample", "e_component")).applyInPandas(_grow(rules), MEMBERS)
    numbered = members.select("sample_id", "component", "seed_place", "found").distinct()
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("seed_place", "component", "found")) - 1
    return members.join(numbered.withColumn("plasmid_no", number), ["sample_id", "component", "seed_place", "found"]).drop("seed_place", "found")


def placed(members: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """Members with ``head`` and ``tail``, the overlaps cut off at either end, ``own`` length, and ``offset`` in the chain.

    A member loses its overlap with the one before it; the last of a ring loses that with the first. Of repeated links
    the last counts if they have an order (``ord``), else the longest overlap.
    """
    by = ["sample_id", "plasmid_no"]
    order, whole = Window.partitionBy(*by).orderBy("pos"), Window.partitionBy(*by)
    length = G.normal_segments(segments).select("sample_id", "seg_name", "seq", F.col("length").alias("seg_length"))
    steps = members.select(*by, "seed", "circular", "pos", "seg_name", "orientation", "depth")
    steps = steps.withColumn("before", F.lag(F.struct("seg_name", "orientation")).over(order)).withColumn("start", F.min_by(F.struct("seg_name", "orientation"), "pos").over(whole))
    steps = steps.withColumn("after", F.when(F.col("circular") & (F.col("pos") == F.max("pos").over(whole)), F.col("start")))
    edges = G.edges(links)
    overlap = F.max_by("overlap", "ord") if "ord" in edges.columns else F.max("overlap")
    ends = edges.groupBy("sample_id", "src", "src_ori", "dst", "dst_ori").agg(overlap.alias("ov"))
    into = ends.select("sample_id", F.struct(F.col("src").alias("seg_name"), F.col("src_ori").alias("orientation")).alias("before"), F.col("dst").alias("seg_name"), F.col("dst_ori").alias("orientation"), F.col("ov").alias("head"))
    out = ends.select("sample_id", F.col("src").alias("seg_name"), F.col("src_ori").alias("orientation"), F.struct(F.col("dst").alias("seg_name"), F.col("dst_ori").alias("orientation")).alias("after"), F.col("ov").alias("tail"))
    joined = steps.join(into, ["sample_id", "before", "seg_name", "orientation"], "left").join(out, ["sample_id", "seg_name", "orientation", "after"], "left").join(length, ["sample_id", "seg_name"])
    head = F.least(F.coalesce("head", F.lit(0)), "seg_length")
    joined = joined.withColumn("head", head).withColumn("tail", F.least(F.coalesce("tail", F.lit(0)), F.col("seg_length") - head))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("seg_length") - F.col("head")).over(earlier), F.lit(0)) - F.col("head")
    return joined.withColumn("own", F.col("seg_length") - F.col("head") - F.col("tail")).withColumn("offset", offset).drop("before", "after", "start")


def facts(members: DataFrame, segments: DataFrame, links: DataFrame, densities: DataFrame, *, hits: DataFrame | None = None, overlap_ends: int | None = None, use_median: bool = False) -> DataFrame:
    """Per candidate: length, depth, density, GC, sequence, number of members; lengths without the overlaps.

    - The sequence and its GC are null where a member's sequence is absent. mean_depth is the median if use_median.
    - Without hits, density is weighted by length. With hits (sample_id, seg_name, sstart, send) it is the share of
      positions of ``chain_coverage``, and ``num_cds`` is the number of different locations on the candidate's segments.
    - overlap_ends: a chain that is no ring is one if its sequence ends with at least so many letters with which it
      begins; these count once.
    """
    by = ["sample_id", "plasmid_no"]
    turned = F.when(F.col("orientation") == "+", F.col("seq")).otherwise(reverse_complement("seq"))
    joined = placed(members, segments, links).join(densities.select("sample_id", "seg_name", "density"), ["sample_id", "seg_name"], "left")
    joined = joined.select(*by, "seed", "circular", "pos", "seg_name", "depth", "own", F.coalesce("density", F.lit(0.0)).alias("density"), F.when(F.col("seq") != "*", F.substring(turned, F.col("head") + 1, F.col("own"))).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("part", F.lit("")).alias("part")))), lambda x: x.part), "")
    found = joined.groupBy(*by, "seed", "circular").agg(
        F.sum("own").cast("bigint").alias("length"), F.count("*").alias("n_members"), F.sum(F.col("depth") * F.col("own")).alias("depths"), F.max_by("depth", "pos").alias("last_depth"),
        F.sum(F.col("density") * F.col("own")).alias("covered"), F.max_by("density", "pos").alias("last_density"), F.when(F.count_if(F.col("part").isNull()) == 0, whole).alias("seq"),
    )
    same = F.lit(0)
    if overlap_ends is not None:
        found = found.withColumn("same", F.when(~F.col("circular") & F.col("seq").isNotNull(), suffix_prefix_overlap("seq")))
        same = F.when(F.col("same") >= overlap_ends, F.col("same")).otherwise(0)
    found = found.withColumn("cut", same).withColumn("length", F.col("length") - F.col("cut"))
    one = F.when(F.col("length") > 0, F.col("length")).otherwise(1)
    found = found.select(
        *by, "seed", (F.col("circular") | (F.col("cut") > 0)).alias("circular"), "length", "n_members", ((F.col("depths") - F.col("last_depth") * F.col("cut")) / one).alias("mean_depth"),
        ((F.col("covered") - F.col("last_density") * F.col("cut")) / one).alias("density"), F.expr("substring(seq, 1, length(seq) - cut)").alias("seq"), "cut",
    )
    if use_median:
        rows = joined.join(found.select(*by, "cut", "n_members"), by).withColumn("own", F.col("own") - F.when(F.col("pos") == F.col("n_members") - 1, F.col("cut")).otherwise(0))
        found = found.drop("mean_depth").join(weighted_median(rows, by, "depth", "own", "mean_depth"), by, "left")
    if hits is not None:
        cover = chain_coverage(members, segments, links, hits, published=True, cuts=found.select(*by, "cut"))
        known = hits.groupBy("sample_id", "seg_name").agg(F.count_distinct("sstart", "send").alias("n"))
        cds = members.select(*by, "seg_name").distinct().join(known, ["sample_id", "seg_name"]).groupBy(*by).agg(F.sum("n").alias("num_cds"))
        found = found.drop("density").join(cover.select(*by, "density"), by, "left").join(cds, by, "left")
        found = found.withColumn("density", F.coalesce("density", F.lit(0.0))).withColumn("num_cds", F.coalesce("num_cds", F.lit(0)))
    return found.drop("cut").withColumn("gc", F.when(F.col("seq").isNotNull(), gc_fraction("seq")))


def collection_facts(members: DataFrame, segments: DataFrame, densities: DataFrame, *, use_median: bool = False) -> DataFrame:
    """Facts of candidates that are no chains (fan-out above 1): sums over whole members, no sequence."""
    by = ["sample_id", "plasmid_no"]
    known = G.normal_segments(segments).select("sample_id", "seg_name", "length", F.col("gc").alias("seg_gc"))
    joined = members.join(known, ["sample_id", "seg_name"]).join(densities.select("sample_id", "seg_name", "density"), ["sample_id", "seg_name"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    found = joined.groupBy(*by, "seed").agg(
        F.sum("length").cast("bigint").alias("length"), F.count("*").alias("n_members"), mean_of("depth", "length").alias("mean_depth"), mean_of("density", "length").alias("density"), mean_of("seg_gc", "length").alias("gc")
    )
    if use_median:
        found = found.drop("mean_depth").join(weighted_median(joined, by, "depth", "length", "mean_depth"), by, "left")
    return found.select(*by, "seed", F.lit(False).alias("circular"), "length", "n_members", "mean_depth", "density", F.lit(None).cast("string").alias("seq"), "gc")


def chain_coverage(members: DataFrame, segments: DataFrame, links: DataFrame, hits: DataFrame, *, published: bool = False, cuts: DataFrame | None = None) -> DataFrame:
    """(sample_id, plasmid_no, covered, density): positions of the chain that genes cover, overlaps counted once.

    hits: (sample_id, seg_name, sstart, send), 1-based. Stretches that run over a chain's end continue at its start.
    published: as in the published densities, stretches on '-' lie one position high and position 0 does not count.
    cuts: (sample_id, plasmid_no, cut), letters at the end that are those at the start.
    """
    by = ["sample_id", "plasmid_no"]
    known = hits.filter("sstart is not null and send is not null").select("sample_id", "seg_name", (F.least("sstart", "send") - 1).alias("a"), (F.greatest("sstart", "send") - 1).alias("b"))
    place = placed(members, segments, links)
    size = place.groupBy(*by).agg(F.sum("own").cast("bigint").alias("size"))
    if cuts is not None:
        size = size.join(cuts, by).select(*by, (F.col("size") - F.col("cut")).alias("size"))
    laid = place.select(*by, "seg_name", "orientation", "seg_length", "offset").join(known, ["sample_id", "seg_name"]).join(size, by)
    shift = F.when((F.col("orientation") == "-") & F.lit(not published), 1).otherwise(0)
    ends = flip(F.col("a"), F.col("b"), F.col("seg_length"), F.col("orientation"))
    laid = laid.select(*by, "size", "offset", shift.alias("shift"), *ends).filter("size > 0")
    at = lambda c: F.col(c).cast("bigint") + F.col("offset") - F.col("shift")
    pieces = laid.select(*by, F.inline(wrapped(at("start"), at("end"), F.col("size"))))
    pieces = pieces.withColumn("start", F.greatest("start", F.lit(1 if published else 0))).filter("`start` <= `end`")
    covered = periods_and_gaps(pieces, by, {"": ("start", "end")}).filter("kind = 'period'").groupBy(*by).agg(F.sum(F.col("pos_to") - F.col("pos_from") + 1).alias("covered"))
    joined = size.join(covered, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return joined.select(*by, "covered", F.try_divide("covered", "size").alias("density"))


def subsets(members: DataFrame) -> DataFrame:
    """(sample_id, plasmid_no) of candidates whose segments all lie in a larger candidate, or in a later equal one.

    Of candidates with the same segments only the last is compared with others, and only with those that have its rarest
    segment, the smallest name of equally rare ones.
    """
    by = ["sample_id", "plasmid_no"]
    each = members.groupBy(*by).agg(F.array_sort(F.collect_set("seg_name")).alias("segments"))
    last = each.groupBy("sample_id", "segments").agg(F.max("plasmid_no").alias("last"))
    equal = each.join(last, ["sample_id", "segments"]).filter("plasmid_no <> last").select(*by)
    sets = last.select("sample_id", F.col("last").alias("plasmid_no"), F.size("segments").alias("n"), F.explode("segments").alias("seg_name"))
    rare = sets.join(sets.groupBy("sample_id", "seg_name").agg(F.count("*").alias("uses")), ["sample_id", "seg_name"])
    pick = rare.groupBy(*by).agg(F.min(F.struct("uses", "seg_name")).alias("r"), F.first("n").alias("n")).select(*by, "n", F.col("r.seg_name").alias("seg_name"))
    other = sets.select("sample_id", F.col("plasmid_no").alias("other"), "seg_name", F.col("n").alias("m"))
    tried = pick.join(other, ["sample_id", "seg_name"]).filter("m > n").select(*by, "n", "other")
    shared = tried.join(sets.select(*by, "seg_name"), by).join(other.select("sample_id", "other", "seg_name"), ["sample_id", "other", "seg_name"])
    inside = shared.groupBy(*by, "n", "other").agg(F.count("*").alias("shared")).filter("shared = n").select(*by)
    return equal.unionByName(inside).distinct()


def classified(found: DataFrame, members: DataFrame, *, min_density: float, min_depth: float | DataFrame, min_length: int, max_length: int, keep_subsets: bool = False) -> DataFrame:
    """Candidates with ``class``: 'putative', or 'questionable' for low density or depth, length, or being a subset.

    min_depth: a number, or (sample_id, plasmid_depth) of ``thresholds``.
    """
    if isinstance(min_depth, DataFrame):
        marked, least = found.join(min_depth.select("sample_id", "plasmid_depth"), "sample_id"), F.col("plasmid_depth")
    else:
        marked, least = found, F.lit(min_depth)
    good = (F.col("density") >= min_density) & (F.col("mean_depth") >= least) & F.col("length").between(min_length, max_length)
    marked = marked.withColumn("good", good).select(*found.columns, "good")
    kept = members.join(marked.filter("good").select("sample_id", "plasmid_no"), ["sample_id", "plasmid_no"], "left_semi")
    inside = subsets(kept).withColumn("inside", F.lit(True)).filter(F.lit(not keep_subsets))
    joined = marked.join(inside, ["sample_id", "plasmid_no"], "left")
    return joined.withColumn("class", F.when(F.col("good") & F.col("inside").isNull(), "putative").otherwise("questionable")).drop("good", "inside")


def chain_lines(members: DataFrame) -> DataFrame:
    """(sample_id, plasmid_no, value): 'plasmid_0;12+,7-', the oriented segments in order."""
    chain = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("seg_name", "orientation").alias("step")))), lambda x: x.step)
    return members.groupBy("sample_id", "plasmid_no").agg(F.array_join(chain, ",").alias("c")).select("sample_id", "plasmid_no", F.concat(F.lit("plasmid_"), "plasmid_no", F.lit(";"), "c").alias("value"))


def record_heads(found: DataFrame, *, use_median: bool = False) -> DataFrame:
    """Definition lines of the candidates' sequences; num_cds where it is known."""
    cds, count = ("num_cds=%d\t", ["num_cds"]) if "num_cds" in found.columns else ("", [])
    text = F.format_string(
        f"plasmid_%s seed_contig=%s\tlength=%d\t{'median' if use_median else 'mean'}_read_depth=%f\tgene_density=%f\t{cds}gc_content=%f\tcircular=%d",
        F.col("plasmid_no").cast("string"), "seed", "length", "mean_depth", "density", *count, "gc", F.col("circular").cast("int"),
    )
    return found.filter("seq is not null").select("sample_id", "plasmid_no", text.alias("head"), "seq")


def member_records(members: DataFrame, segments: DataFrame) -> DataFrame:
    """(sample_id, plasmid_no, head, seq): each member's sequence as it lies in its chain, under 'segment|place_plasmid'."""
    seqs = segments.filter("seq <> '*'").select("sample_id", "seg_name", "seq")
    turned = F.when(F.col("orientation") == "+", F.col("seq")).otherwise(reverse_complement("seq"))
    place = F.col("member" if "member" in members.columns else "pos").cast("string")
    head = F.concat("seg_name", F.lit("|"), place, F.lit("_plasmid_"), F.col("plasmid_no").cast("string"))
    return members.join(seqs, ["sample_id", "seg_name"]).select("sample_id", "plasmid_no", head.alias("head"), turned.alias("seq"))


def seed_weights(seeds: DataFrame) -> DataFrame:
    """Per sample the weights that the seeds' spread suggests: weighted deviations of depth, density and GC; 0 for one seed."""
    spread = deviations(seeds, ["sample_id"], ["depth", "density", "gc"], "length").join(seeds.groupBy("sample_id").count(), "sample_id")
    return spread.select("sample_id", *[F.when(F.col("count") > 1, F.col(f"{c}_sd")).otherwise(0.0).alias(n) for c, n in (("depth", "depth_diff"), ("density", "gene_density"), ("gc", "gc_diff"))])


def unused_statistics(segments: DataFrame, members: DataFrame) -> DataFrame:
    """Per sample: number, length, mean and median depth and GC of the segments that no candidate uses."""
    rest = G.normal_segments(segments).join(members.select("sample_id", "seg_name").distinct(), ["sample_id", "seg_name"], "left_anti").filter("depth is not null and length is not null")
    sums = rest.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("length").alias("length"), mean_of("depth", "length").alias("mean_depth"), mean_of("gc", "length").alias("gc"))
    return sums.join(weighted_median(rest, ["sample_id"], "depth", "length", "median_depth"), "sample_id", "left")


BINS = "sample_id int, plasmid_no int, bin_no int, place int"


def _bins(factor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", "plasmid_no"], ascending=[False, True])
        depth, gc, ring, number = (rows[c].to_numpy() for c in ("mean_depth", "gc", "circular", "plasmid_no"))
        free, out, bin_no = np.ones(len(rows), bool), [], 0
        depth_room, gc_room = factor * rows.depth_sd.iloc[0], factor * rows.gc_sd.iloc[0]
        by_depth = np.argsort(depth, kind="stable")
        low, high = (np.searchsorted(depth[by_depth], depth + s * depth_room * (1 + 1e-9), side) for s, side in ((-1, "left"), (1, "right")))
        for i in range(len(rows)):
            if free[i]:
                taken = np.array([i])
                if not ring[i]:
                    near = np.sort(by_depth[max(low[i] - 1, 0) : high[i] + 1])
                    taken = near[free[near] & (np.abs(depth[near] - depth[i]) <= depth_room) & (np.abs(gc[near] - gc[i]) <= gc_room)]
                free[taken] = False
                out += [(rows.sample_id.iloc[0], number[j], bin_no, k) for k, j in enumerate(taken)]
                bin_no += 1
        return pd.DataFrame(out, columns=["sample_id", "plasmid_no", "bin_no", "place"])

    return run


def bins(found: DataFrame, segments: DataFrame, factor: float = 2.5) -> DataFrame:
    """(sample_id, plasmid_no, bin_no, place): candidates that belong together by depth and GC.

    From the highest sum of normalised depth, density and GC difference on, a candidate takes with it all that are left
    within ``factor`` deviations; a ring stays alone. As published, depths are compared with the deviation of their
    ratios to the sample's median. Only the short facts of a sample's candidates meet in one task.
    """
    normal = G.normal_segments(segments).filter("length is not null")
    overall = normal.groupBy("sample_id").agg(mean_of("gc", "length").alias("overall"))
    median = weighted_median(normal, ["sample_id"], "depth", "length", "median")
    rows = found.filter("gc is not null and length > 0").select("sample_id", "plasmid_no", "length", "mean_depth", "density", "gc", "circular").join(overall, "sample_id").join(median, "sample_id")
    rows = rows.withColumn("ratio", F.col("mean_depth") / F.col("median")).withColumn("gc_diff", F.abs(F.col("gc") - F.col("overall")))
    spread = deviations(rows, ["sample_id"], ["ratio", "density", "gc_diff"], "length")
    one = lambda c: F.when(F.col(c) < 1e-12, 1.0).otherwise(F.col(c))
    z = sum((F.col(c) - F.col(f"{c}_mean")) / one(f"{c}_sd") for c in ("ratio", "density", "gc_diff"))
    ranked = rows.join(spread, "sample_id").select("sample_id", "plasmid_no", "mean_depth", "gc", "circular", z.alias("z"), one("ratio_sd").alias("depth_sd"), one("gc_diff_sd").alias("gc_sd"))
    return ranked.groupBy("sample_id").applyInPandas(_bins(factor), BINS)


def bin_lines(found: DataFrame) -> DataFrame:
    """(sample_id, value): the candidates of each bin, comma-separated, a line for each bin."""
    lines = found.groupBy("sample_id", "bin_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "plasmid_no"))), lambda x: F.concat(F.lit("plasmid_"), x.plasmid_no.cast("string"))), ",").alias("value"))
    return lines.select("sample_id", "value")


def tagged_lines(lines: DataFrame, members: DataFrame, classes: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample_id, ord, value): a graph's lines with a label and colour on segments of candidates, comments dropped.

    lines: as read; classes: (sample_id, plasmid_no, class); genes: (sample_id, seg_name) of segments with genes, starred.
    """
    label = members.join(classes.select("sample_id", "plasmid_no", "class"), ["sample_id", "plasmid_no"]).groupBy("sample_id", "seg_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("plasmid_no")), lambda n: n.cast("string")), ",").alias("ids"), F.max(F.col("class") == "putative").alias("sure")
    )
    starred = genes.select("sample_id", "seg_name").distinct().withColumn("star", F.lit("*"))
    rows = lines.filter(F.col("parts")[0].isin("H", "S", "L", "C", "P")).withColumn("seg_name", F.when(F.col("parts")[0] == "S", F.col("parts")[1]))
    joined = rows.join(label, ["sample_id", "seg_name"], "left").join(starred, ["sample_id", "seg_name"], "left")
    colour = F.when(F.col("sure"), "CL:z:blue").otherwise("CL:z:lightblue")
    tags = F.when(F.col("ids").isNotNull(), F.concat(F.lit("\tLB:z:"), F.coalesce("star", F.lit("")), "ids", F.lit("\t"), colour)).otherwise("")
    return joined.select("sample_id", "ord", F.concat(F.array_join("parts", "\t"), tags).alias("value"))
