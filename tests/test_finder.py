import random
from collections import defaultdict

import pytest

from ringweave.operators import finder as P

SEG = "sample_id int, seg_name string, seq string, length int, kmer_count long, depth double"
LINK = "sample_id int, from_seg string, from_ori string, to_seg string, to_ori string, overlap string"
DENS = "sample_id int, seg_name string, density double, has_genes boolean"


def test_ring_is_closed_and_peeled(spark):
    segments = spark.createDataFrame([(1, n, s, len(s), None, 2.0) for n, s in (("a", "ACGTACGTAC"), ("b", "GGGTTTAACC"), ("c", "TTTTTGGGGG"))] + [(1, "far", "A" * 10, 10, None, 1.0)], SEG)
    links = spark.createDataFrame([(1, "a", "+", "b", "+", "2M"), (1, "b", "+", "c", "-", "0M"), (1, "c", "-", "a", "+", "3M")], LINK)
    dens = spark.createDataFrame([(1, "a", 0.9, True), (1, "b", 0.5, True), (1, "c", 0.5, True)], DENS)
    got = P.grow(segments, links, dens, P.Growth(max_score=5, max_gc_diff=1), min_density=0.8).cache()
    assert {(r.seg_name, r.depth, r.circular) for r in got.collect()} == {("a", 2.0, True), ("b", 2.0, True), ("c", 2.0, True)}
    fact = P.facts(got, segments, links, dens).first()
    assert (fact.length, fact.n_members, fact.mean_depth, fact.circular) == (25, 3, 2.0, True)
    assert len(fact.seq) == 25 and fact.gc == pytest.approx(sum(c in "GC" for c in fact.seq) / 25)
    line = P.chain_lines(got).first().value
    assert line.startswith("plasmid_0;") and sorted(line[10:].split(",")) in (["a+", "b+", "c-"], ["a-", "b-", "c+"])
    head = P.record_heads(P.facts(got, segments, links, dens)).first().head
    assert "seed_contig=a\tlength=25\tmean_read_depth=2.000000" in head and head.endswith("circular=1")


def test_invariants_on_random_graphs(spark):
    rng = random.Random(8)
    seg = [(s, f"n{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 60))), None, None, round(rng.random() * 3, 3)) for s in (1, 2, 3) for i in range(25)]
    link = [(s, f"n{rng.randrange(25)}", rng.choice("+-"), f"n{rng.randrange(25)}", rng.choice("+-"), "5M") for s in (1, 2, 3) for _ in range(30)]
    dens = [(s, n, round(rng.random(), 2), rng.random() < 0.6) for s, n, *_ in seg]
    rules = P.Growth(max_score=3, max_length=400, max_gc_diff=0.4, max_gap_nt=50)
    got = P.grow(spark.createDataFrame(seg, SEG), spark.createDataFrame(link, LINK), spark.createDataFrame(dens, DENS), rules, min_density=0.4).collect()
    depth, length = {(s, n): d for s, n, _, _, _, d in seg}, {(s, n): len(q) for s, n, q, *_ in seg}
    flip = {"+": "-", "-": "+"}
    ways = {(s, a, x, b, y) for s, a, x, b, y, _ in link} | {(s, b, flip[y], a, flip[x]) for s, a, x, b, y, _ in link}
    taken, chains = defaultdict(float), defaultdict(list)
    for r in got:
        taken[r.sample_id, r.seg_name] += r.depth
        chains[r.sample_id, r.plasmid_no].append(r)
    assert got and all(taken[k] <= depth[k] + 1e-9 for k in taken)
    for (sample, _), chain in chains.items():
        chain.sort(key=lambda r: r.pos)
        assert [r.pos for r in chain] == list(range(len(chain))) and chain[0].seed in [r.seg_name for r in chain]
        steps = list(zip(chain, chain[1:])) + ([(chain[-1], chain[0])] if chain[0].circular else [])
        assert all((sample, a.seg_name, a.orientation, b.seg_name, b.orientation) in ways for a, b in steps)
        assert sum(length[sample, r.seg_name] for r in chain) <= 400
    for sample in (1, 2, 3):
        assert sorted(n for s, n in chains if s == sample) == list(range(sum(s == sample for s, _ in chains)))


def test_subsets(spark):
    rng = random.Random(9)
    sets = {(s, p): frozenset(rng.sample("abcdef", rng.randrange(1, 5))) for s in (1, 2) for p in range(25)}
    df = spark.createDataFrame([(s, p, x) for (s, p), xs in sets.items() for x in xs], "sample_id int, plasmid_no int, seg_name string")
    expected = {(s, p) for (s, p), a in sets.items() if any(t == s and q != p and a <= b and (len(b) > len(a) or q > p) for (t, q), b in sets.items())}
    assert {tuple(r) for r in P.subsets(df).collect()} == expected


def test_no_seed(spark):
    segments = spark.createDataFrame([(1, "a", "ACGT", 4, None, 1.0)], SEG)
    links, dens = spark.createDataFrame([], LINK), spark.createDataFrame([], DENS)
    assert P.grow(segments, links, dens).collect() == []


def test_by_segment_closes_a_ring_once(spark):
    segments = spark.createDataFrame([(1, n, "ACGTACGTAC", 10, None, 2.0) for n in "ab"], SEG)
    links = spark.createDataFrame([(1, "a", "+", "b", "+", "0M"), (1, "b", "+", "a", "+", "0M")], LINK)
    dens = spark.createDataFrame([(1, "a", 0.9, True), (1, "b", 0.5, True)], DENS)
    got = P.grow(segments, links, dens, P.Growth(max_score=5, max_gc_diff=1, by_segment=True), min_density=0.8).collect()
    assert sorted((r.seg_name, r.depth, r.circular) for r in got) == [("a", 2.0, True), ("b", 2.0, True)]
    rules = P.Growth(max_score=5, max_gc_diff=1, roulette=3)
    first, again = ([tuple(r) for r in P.grow(segments, links, dens, rules, min_density=0.8).collect()] for _ in range(2))
    assert sorted(first) == sorted(again) and {r[-2] for r in first} <= {0, 1, True, False, 2.0} and len(first) >= 2


def test_bins_labels_and_weights(spark):
    facts = [(1, 0, 100, 2.0, 0.9, 0.5, False), (1, 1, 100, 2.1, 0.5, 0.5, False), (1, 2, 100, 9.0, 0.5, 0.5, False), (1, 3, 100, 2.05, 0.4, 0.5, True)]
    found = spark.createDataFrame(facts, "sample_id int, plasmid_no int, length long, mean_depth double, density double, gc double, circular boolean")
    segments = spark.createDataFrame([(1, "a", "ACGT", 4, None, 2.0)], SEG)
    got = {r.plasmid_no: r.bin_no for r in P.bins(found, segments, 0.5).collect()}
    assert got[0] == got[1] != got[2] and sorted(got) == [0, 1, 2, 3]
    lines = spark.createDataFrame([("1", 0, ["H", "x"]), ("1", 1, ["S", "a", "AC"]), ("1", 2, ["S", "b", "AC"]), ("1", 3, ["#", "c"])], "sample_id string, ord int, parts array<string>")
    members = spark.createDataFrame([("1", 2, "a"), ("1", 10, "a")], "sample_id string, plasmid_no int, seg_name string")
    classes = spark.createDataFrame([("1", 2, "questionable"), ("1", 10, "putative")], "sample_id string, plasmid_no int, class string")
    tagged = {r.ord: r.value for r in P.tagged_lines(lines, members, classes, members).collect()}
    assert tagged == {0: "H\tx", 1: "S\ta\tAC\tLB:z:*2,10\tCL:z:blue", 2: "S\tb\tAC"}
    seeds = spark.createDataFrame([(1, 10, 1.0, 0.5, 0.5), (1, 10, 3.0, 0.5, 0.5), (2, 5, 1.0, 1.0, 1.0)], "sample_id int, length int, depth double, density double, gc double")
    assert {tuple(r) for r in P.seed_weights(seeds).collect()} == {(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)}
    rest = P.unused_statistics(segments, members.filter("false").select(members.sample_id.cast("int"), "seg_name")).first()
    assert (rest.n, rest.length, rest.mean_depth, rest.median_depth) == (1, 4, 2.0, 2.0)


def test_coverage_along_a_ring(spark):
    rng = random.Random(10)
    names, length = "abc", {"a": 30, "b": 20, "c": 25}
    segments = spark.createDataFrame([(1, n, "".join(rng.choice("ACGT") for _ in range(length[n])), length[n], None, 1.0) for n in names], SEG)
    links = spark.createDataFrame([(1, "a", "+", "b", "-", "4M"), (1, "b", "-", "c", "+", "0M"), (1, "c", "+", "a", "+", "6M")], LINK)
    chain = [("a", "+"), ("b", "-"), ("c", "+")]
    members = spark.createDataFrame([(1, 0, "a", True, i, n, o, 1.0) for i, (n, o) in enumerate(chain)], "sample_id int, plasmid_no int, seed string, circular boolean, pos int, seg_name string, orientation string, depth double")
    hits = [(n, a := rng.randrange(1, length[n] - 4), min(length[n], a + rng.randrange(1, 6))) for n in names for _ in range(2)] + [("c", 22, 25), ("a", 1, 3), ("b", 9, 5)]
    size, offset, covered = 30 + 16 + 25 - 6, {"a": 0, "b": 26, "c": 46}, set()
    for n, x, y in hits:
        a, b = min(x, y) - 1, max(x, y) - 1
        if n == "b":
            a, b = 19 - b, 19 - a
        covered |= {(offset[n] + p) % size for p in range(a, b + 1)}
    df = spark.createDataFrame([(1, *h) for h in hits], "sample_id int, seg_name string, sstart int, send int")
    got = P.chain_coverage(members, segments, links, df).first()
    assert (got.covered, got.density) == (len(covered), pytest.approx(len(covered) / size))
    assert P.chain_coverage(members, segments, links, df, published=True).first().covered <= len(covered) + 1
    fact = P.facts(members, segments, links, spark.createDataFrame([], DENS)).first()
    seq = {r.seg_name: r.seq for r in segments.collect()}
    flipped = seq["b"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert fact.seq == (seq["a"] + flipped[4:] + seq["c"])[:-6] and fact.length == size


def test_chains_cross_segments_without_genes_by_default(spark):
    from ringweave.plans.finder import RULES

    segments = spark.createDataFrame([(1, n, "ACGT" * k, 4 * k, None, d) for n, k, d in (("a", 100, 2.0), ("b", 200, 2.6), ("c", 100, 2.0))], SEG)
    links = spark.createDataFrame([(1, "a", "+", "b", "+", "0M"), (1, "b", "+", "c", "+", "0M")], LINK)
    dens = spark.createDataFrame([(1, "a", 0.9, True), (1, "c", 0.2, True)], DENS)
    for rules in (P.Growth(), RULES):
        line = P.chain_lines(P.grow(segments, links, dens, rules, min_density=0.8)).first().value
        assert line == "plasmid_0;a+,b+,c+"
    assert (RULES.max_score, RULES.max_gap_nt, RULES.max_gap_segments, RULES.max_length, RULES.max_gc_diff) == (float("inf"), 2000, 2, 1_750_000, 0.15)


def test_bins_as_a_plain_loop_makes_them(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n, factor = 150, 0.4
    z, depth, gc, ring = rng.normal(size=n).round(1), rng.normal(3, 1, n).round(2), rng.normal(0.5, 0.05, n).round(2), rng.random(n) < 0.2
    import pandas as pd

    rows = pd.DataFrame({"sample_id": 7, "plasmid_no": np.arange(n), "mean_depth": depth, "gc": gc, "circular": ring, "z": z, "depth_sd": 0.8, "gc_sd": 0.04})
    order, free, expected, bin_no = sorted(range(n), key=lambda i: (-z[i], i)), set(range(n)), {}, 0
    for i in order:
        if i in free:
            taken = [i] if ring[i] else [j for j in order if j in free and abs(depth[j] - depth[i]) <= factor * 0.8 and abs(gc[j] - gc[i]) <= factor * 0.04]
            for k, j in enumerate(taken):
                expected[j] = (bin_no, k)
            free -= set(taken)
            bin_no += 1
    got = P._bins(factor)(rows)
    assert {r.plasmid_no: (r.bin_no, r.place) for r in got.itertuples()} == expected and bin_no > 20


def test_equal_chains_by_their_ends_are_rings(spark):
    segments = spark.createDataFrame([(1, "a", "ACGTTGCA" + "C" * 12 + "ACGTTGCA", 28, None, 2.0), (1, "b", "GGGCCA", 6, None, 1.0)], SEG)
    links = spark.createDataFrame([], LINK)
    members = spark.createDataFrame([(1, 0, "a", False, 0, "a", "+", 2.0), (1, 1, "b", False, 0, "b", "-", 1.0)], "sample_id int, plasmid_no int, seed string, circular boolean, pos int, seg_name string, orientation string, depth double")
    hits = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 1, 10), (1, "a", 15, 12)], "sample_id int, seg_name string, sstart int, send int")
    got = {r.plasmid_no: r for r in P.facts(members, segments, links, spark.createDataFrame([], DENS), hits=hits, overlap_ends=8, use_median=True).collect()}
    assert (got[0].length, got[0].circular, got[0].num_cds, got[0].mean_depth, got[0].seq) == (20, True, 2, 2.0, "ACGTTGCA" + "C" * 12)
    assert (got[1].length, got[1].circular, got[1].num_cds, got[1].density) == (6, False, 0, 0.0)
    assert P.record_heads(P.facts(members, segments, links, spark.createDataFrame([], DENS), hits=hits), use_median=True).filter("plasmid_no = 0").first().head.count("median_read_depth=2.000000\t") == 1
