import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringweave.functions import sequences as S
from ringweave.operators import evaluation as E
from ringweave.operators import graph as G
from ringweave.operators import hits as H
from ringweave.operators import references as R
from ringweave.operators import weighted as W


def median_by_loop(pairs):
    pairs = sorted(pairs)
    total = sum(w for _, w in pairs)
    rank, part, seen = math.floor(total / 2), total / 2 - math.floor(total / 2), 0
    for i, (v, w) in enumerate(pairs):
        seen += w
        if seen >= rank:
            right = v if seen >= rank + 1 or i + 1 == len(pairs) else pairs[i + 1][0]
            return v + (right - v) * part


def test_weighted_median_and_n50(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([0.5, 1.25, rng.random() * 9, -rng.random()]), rng.randrange(1, 60)) for g in "abc" for _ in range(rng.randrange(1, 70))] + [("d", None, 3), ("d", 2.0, 5), ("e", None, 4)]
    df = spark.createDataFrame(data, "g string, v double, w int")
    got = {r.g: r.m for r in W.weighted_median(df, ["g"], "v", "w", "m").collect()}
    expected = {g: median_by_loop([(v, w) for k, v, w in data if k == g and v is not None]) for g in "abcd"}
    assert got == pytest.approx(expected)

    def n50(lengths):
        upto = 0
        for x in sorted(lengths):
            upto += x
            if upto >= sum(lengths) / 2:
                return x

    assert {r.g: r.n50 for r in W.n50(df, ["g"], "w").collect()} == {g: n50([w for k, _, w in data if k == g]) for g in "abcde"}


def test_contained_and_overlaps(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("ab"), a := rng.randrange(1, 60), a + rng.randrange(0, 20)) for i in range(90)] + [(90, "a", None, 3), (91, "c", 1, 9)]
    df = spark.createDataFrame(data, "hit_id long, qseqid string, qstart int, qend int")
    good = [d for d in data if d[2] is not None]
    inside = {i for i, q, a, b in good if any(j != i and p == q and c <= a and b <= d for j, p, c, d in good)}
    assert {r.hit_id for r in H.contained(df).collect()} == inside
    overlap = {q: sum(max(0, min(b, d) - max(a, c) + 1) for i, p, a, b in good for j, o, c, d in good if p == o == q and i < j) for q in "abc"}
    assert {r.qseqid: r.overlap for r in H.pairwise_overlaps(df).collect()} == overlap


def test_filter_thresholds_and_fragments(spark):
    genes = spark.createDataFrame([("g1", "A" * 100), ("g2", "C" * 100), ("g3", "G" * 100)], "gene_id string, seq string")
    hits = spark.createDataFrame(
        [
            (1, "g1", "c", 95.0, 95, 1, 95), (2, "g1", "c", 94.9, 100, 1, 100), (3, "g1", "c", 99.0, 94, 1, 94), (4, "g2", "c", 97.0, 50, 1, 50), (5, "g2", "d", 97.0, 50, 51, 100),
            (6, "g2", "d", 97.0, 10, 55, 64), (7, "zz", "d", 99.0, 99, 1, 99), (8, "g1", "c", None, 99, 1, 99),
        ], "hit_id long, qseqid string, sseqid string, pident double, length int, qstart int, qend int",
    )
    got = {r.hit_id: r.verdict for r in H.classified(hits, genes).collect()}
    assert got == {1: "kept", 2: "identity", 3: "length", 4: "length", 5: "length", 6: "length", 8: "identity"}
    assert [r.qseqid for r in H.unknown_genes(hits, genes).collect()] == ["zz"]
    assert {(r.gene_id, r.hit_class) for r in H.hit_classes(hits, genes).collect()} == {("g1", "many"), ("g2", "many"), ("g3", "none")}
    assert {r.hit_id for r in H.with_fragments(hits, genes).collect()} == {1, 4, 5}
    assert {r.hit_id for r in H.fragmented(hits, genes, variant="simple").collect()} == {1, 3, 4, 5, 6}


def test_expressions(spark):
    df = spark.createDataFrame([("ACGTRYN*acg", "abcab", "55M"), ("", "", "20M1I34M"), (None, None, None)], "s string, t string, o string")
    got = df.select(S.reverse_complement("s").alias("rc"), F.round(S.gc_fraction("s"), 4).alias("gc"), S.suffix_prefix_overlap("t").alias("k"), S.overlap_length("o").alias("ov")).collect()
    assert [tuple(r) for r in got] == [("cgt*NRYACGT", round(4 / 11, 4), 2, 55), ("", 0.0, 0, 0), (None, 0.0, None, 0)]
    weights = spark.range(1).select(S.weight_map(F.lit("depth_diff=1,gc_diff=?")).alias("w")).first().w
    assert weights == {"depth_diff": 1.0, "gc_diff": None}
    rep = spark.createDataFrame([("p1:NZ_X.1/X.1",), ("p:NZ_X.1/",), ("X.1",)], "r string").select(S.replicon_accessions("r"), S.replicon_accessions("r", "genbank"), S.replicon_accessions("r", "both"))
    assert [tuple(r) for r in rep.collect()] == [("NZ_X.1", "X.1", ["NZ_X.1", "X.1"]), ("NZ_X.1", None, ["NZ_X.1"]), ("X.1", "X.1", ["X.1"])]
    ring = spark.createDataFrame([(2, 5), (8, 12), (13, 15)], "a int, b int").select(S.wrapped(F.col("a"), F.col("b"), F.lit(10)).alias("w")).collect()
    assert [[tuple(x) for x in r.w] for r in ring] == [[(2, 5)], [(8, 9), (0, 2)], [(3, 5)]]
    labels = spark.createDataFrame([("x nz pl00000012.3 y",), ("none",), (None,)], "l string").select(S.accession_in("l").alias("a")).collect()
    assert [r.a for r in labels] == ["NZ_PL00000012.3", None, None]
    scored = spark.createDataFrame([(2.0, 0.5, 1.0, 0.25, 0.4), (0.0, 0.5, 1.0, 0.25, 0.4)], "d double, g double, e double, n double, h double")
    w = {"depth_diff": 1.0, "gene_density": 2.0, "gc_diff": 10.0}
    assert [r[0] for r in scored.select(S.extension_score(*[F.col(c) for c in "dgenh"], w)).collect()] == [pytest.approx(0.5 + 1.5 + 1.0), float("inf")]


def test_components_and_degrees(spark):
    segments = spark.createDataFrame([(s, n, "*", 10, 5, 1.0) for s in (1, 2) for n in "abcdefg"], "sample_id int, seg_name string, seq string, length int, kmer_count long, depth double")
    links = spark.createDataFrame(
        [(1, "a", "+", "b", "-", "5M"), (1, "b", "+", "c", "+", None), (1, "d", "+", "d", "+", "*"), (2, "g", "-", "f", "-", "0M"), (2, "g", "-", "f", "-", "0M")],
        "sample_id int, from_seg string, from_ori string, to_seg string, to_ori string, overlap string",
    )
    got = {(r.sample_id, r.seg_name): r.component for r in G.components(segments, links).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "e", (1, "f"): "f", (1, "g"): "g", (2, "f"): "f", (2, "g"): "f", **{(2, c): c for c in "abcde"}}
    degree = {(r.sample_id, r.seg_name): r.degree for r in G.degrees(segments, links).collect()}
    assert (degree[1, "b"], degree[1, "d"], degree[2, "g"], degree[2, "a"]) == (2, 2, 2, 0)
    only = spark.createDataFrame([(1, "a"), (1, "c")], "sample_id int, seg_name string")
    assert {(r.seg_name, r.component) for r in G.components(segments, links, only).collect()} == {("a", "a"), ("c", "c")}


def test_references_and_database(spark):
    df = spark.createDataFrame([(1, "AACG"), (2, "CGTT"), (3, "AAAA"), (4, "AACG")], "n int, s string")
    assert {tuple(r) for r in R.identical_groups(df, "n", "s").collect()} == {(1, 1, 3), (2, 1, 3), (4, 1, 3)}
    assert {r.n for r in R.dereplicated(df, "s", "n").collect()} == {1, 2, 3}
    plasmids = spark.createDataFrame([("a", 10, "2015-01-01"), ("b", 10, "2016-01-01"), ("c", 10, None), ("d", 3, "2014-01-01")], "plasmid string, length int, release_date string")
    genes = spark.createDataFrame([("a", 1, "ACGT"), ("a", 2, "ACGT"), ("a", 3, "A"), ("b", 1, "ACGT"), ("d", 1, "GGGG")], "plasmid string, gene_no int, seq string")
    none = spark.createDataFrame([], "plasmid string")
    assert [tuple(r) for r in R.database(plasmids, genes, none, released_before="2016-01-01", plasmid_range=(5, 99), min_gene=2).collect()] == [("a", 1, "ACGT")]
    assert R.database(plasmids, genes, plasmids.select("plasmid")).count() == 0


def test_scores_without_predictions(spark):
    refs = spark.createDataFrame([("t", 1, "p", 10, None, 1.0), ("t", 1, "q", 30, 0.5, 0.5), ("u", 1, "p", 10, 0.0, 0.0)], "tool string, sample_id int, plasmid_id string, length int, best_recall double, union_recall double")
    preds = spark.createDataFrame([("t", 1, "x", 5, 1.0, 0.5)], "tool string, sample_id int, plasmid_id string, length int, best_precision double, union_precision double")
    got = {(r.tool, r.evaluation): (r.precision, r.recall) for r in E.scores(refs, preds, ["tool"]).collect()}
    assert got == {("t", "best"): (1.0, 0.375), ("t", "union"): (0.5, 0.625), ("u", "best"): (0.0, 0.0), ("u", "union"): (0.0, 0.0)}
    filled = E.zero_filled(refs.groupBy("tool").count(), spark.createDataFrame([("t",), ("v",)], "tool string"), ["tool"], ["count"])
    assert {tuple(r) for r in filled.collect()} == {("t", 2, False), ("v", 0, True)}
    assert spark.range(1).select(E.levels(45, 20).alias("l")).first().l == [0, 20, 40, 45]
    wide = spark.createDataFrame([("k", 1, "x")], "key string, a int, b string")
    assert {tuple(r) for r in E.unpivoted(wide, "key", ["a", "b", "absent"]).collect()} == {("k", "a", "1"), ("k", "b", "x")}


def test_translocations(spark):
    lengths = spark.createDataFrame([("a", 100), ("b", 50), ("z", 10)], "contig string, length int")
    hits = spark.createDataFrame(
        [("a", "b", 1, 40, 1, 40), ("a", "c", 30, 60, 1, 31), ("a", "a", 1, 100, 1, 100), ("b", "c", 1, 10, 1, 10), ("b", "a", 11, 20, 1, 10)],
        "qseqid string, sseqid string, qstart int, qend int, sstart int, send int",
    )
    got = {r.contig: (r.partner, r.matched, r.translocated, r.unaligned) for r in E.translocations(hits, lengths).collect()}
    assert got == {"a": ("b", 0.4, 0.2, 0.4), "b": ("a", 0.2, 0.2, 0.6), "z": (None, 0.0, 0.0, 1.0)}


def test_pieces_behind_the_first_lap(spark):
    rows = [(2, 5), (9, 10), (8, 12), (13, 15), (18, 22), (38, 41), (3, 12), (5, 30), (12, 21), (25, 60)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", F.inline(S.wrapped(F.col("a"), F.col("b"), F.lit(10)))).collect()
    for a, b in rows:
        pieces = [(r.start, r.end) for r in got if (r.a, r.b) == (a, b)]
        assert all(0 <= x <= y < 10 for x, y in pieces)
        assert {p for x, y in pieces for p in range(x, y + 1)} == {p % 10 for p in range(a, b + 1)}


def test_quantiles_and_places(spark):
    rng = random.Random(12)
    data = [(rng.choice("ab"), rng.choice([None, 0.0, -1.5, 3.0, rng.random() * 1000, -rng.random()]), i) for i in range(300)] + [("one", 4.0, 1)]
    df = spark.createDataFrame(data, "k string, v double, i int")
    got = {r.k: (r.a, r.b) for r in W.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}).collect()}
    for k in ("a", "b", "one"):
        values = np.array([v for x, v, _ in data if x == k and v is not None])
        assert got[k] == pytest.approx((np.quantile(values, 0.25), np.quantile(values, 0.5)))
    known = df.filter("v is not null")
    placed = {(r.k, r.i): r.place for r in W.places(known, ["k"], "v", F.desc("i")).collect()}
    expected = {(k, i): n + 1 for k in ("a", "b", "one") for n, (_, i) in enumerate(sorted([(v, i) for x, v, i in data if x == k and v is not None], key=lambda x: (x[0], -x[1])))}
    assert placed == expected


def test_levels_of_scores_and_bins(spark):
    refs = spark.createDataFrame([("t", f"p{i:02}", 10, 1.0 if i % 2 else None) for i in range(7)], "tool string, plasmid_id string, length int, union_recall double")
    got = {(r.level, r.repetitions): r.recall for r in E.level_scores(refs, ["plasmid_id"], 3).collect()}
    assert got == {(0, 1): 0.0, (3, 3): pytest.approx(1 / 3), (6, 3): 0.5, (7, 1): pytest.approx(3 / 7)}
    hits = spark.createDataFrame([("q", "x", 1, 10), ("q", "y", 8, 20), ("q", "z", 40, 45)], "qseqid string, sseqid string, qstart int, qend int")
    members = spark.createDataFrame([("x", "b1"), ("y", "b1"), ("z", "b2")], "contig string, bin string")
    lengths = spark.createDataFrame([("q", 100)], "contig string, length int")
    row = E.translocations(E.binned(hits, members), lengths).first()
    assert (row.partner, row.matched, row.translocated, row.unaligned) == ("b1", 0.2, 0.06, 0.74)


def test_scratch_tables_are_removed(spark, monkeypatch):
    from ringweave import session

    monkeypatch.setattr(session, "_BASES", set())
    scratch = session.Scratch(spark, "test")
    assert scratch.write(spark.range(3), "three").count() == 3
    session.remove_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.base}/three").count()


def test_no_folder_on_a_cluster():
    from ringweave.session import shared_folder

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: {"spark.master": "spark://host:7077"}.get(name, default))

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Cluster)
