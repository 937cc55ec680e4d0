"""Growth against a plain model of its rules, member by member."""

import random
from collections import Counter, defaultdict

import pytest

from ringweave.operators import finder as P
from ringweave.operators import graph as G

SEG = "sample_id int, seg_name string, seq string, length int, kmer_count long, depth double"
LINK = "sample_id int, from_seg string, from_ori string, to_seg string, to_ori string, overlap string"
DENS = "sample_id int, seg_name string, density double, has_genes boolean"
OTHER = {"+": "-", "-": "+"}


def median(rows):
    """Weighted median of (value, whole weight), interpolated where half the weight lies between two ranks."""
    every = [v for v, n in sorted(rows) for _ in range(n)]
    rank = len(every) // 2
    left, right = every[max(rank - 1, 0)], every[min(rank, len(every) - 1)]
    return left + (right - left) * (len(every) / 2 - rank)


def model(facts, links, seeds, least, rules):
    """facts: name -> (length, depth, gc, density, genes). Returns [(seed, [(name, orientation, depth)], ring)] in order."""
    after = defaultdict(set)
    for a, x, b, y in links:
        if a in facts and b in facts:
            after[a, x].add((b, y))
            after[b, OTHER[y]].add((a, OTHER[x]))
    before = defaultdict(set)
    for here, nexts in after.items():
        for there in nexts:
            before[there].add(here)
    left_over, stack, out = {n: f[1] for n, f in facts.items()}, list(seeds), []
    length, gc_of, density, genes = ({n: f[i] for n, f in facts.items()} for i in (0, 2, 3, 4))

    while stack:
        chain, ids, gaps, scores = [(stack[0], "+")], [0], {0: (0, 0)}, {0: rules.weights[1] * (1 - density[stack[0]])}
        used, ring, fresh = set(), False, 1

        def depth_of(chain, names):
            rows = [(left_over[n] / (1 if rules.by_segment else names[n]), length[n]) for n, _ in chain]
            return median(rows) if rules.use_median else sum(d * n for d, n in rows) / sum(n for _, n in rows)

        while True:
            names = Counter(n for n, _ in chain)
            total = sum(length[n] for n, _ in chain)
            mean_depth, mean_gc = depth_of(chain, names), sum(gc_of[n] * length[n] for n, _ in chain) / total
            options = []
            for side, end in ((0, 0), (1, len(chain) - 1)):
                me = ids[end]
                for name, way in sorted((after if side else before)[chain[end]]):
                    pair = (chain[end], (name, way)) if side else ((name, way), chain[end])
                    mirror = ((pair[1][0], OTHER[pair[1][1]]), (pair[0][0], OTHER[pair[0][1]]))
                    seen = names[name] > 0
                    if rules.by_segment:
                        if ring or (seen and name != chain[-1 - end if len(chain) > 1 else 0][0]):
                            continue
                        share, more = left_over[name], 0 if seen else length[name]
                    else:
                        if pair in used or mirror in used:
                            continue
                        share, more = left_over[name] / (names[name] + 1), length[name]
                    nt, count = gaps[me]
                    if share < least or abs(mean_gc - gc_of[name]) > rules.max_gc_diff or not (nt + length[name] <= rules.max_gap_nt or count < rules.max_gap_segments or genes[name]):
                        continue
                    w = rules.weights
                    score = w[0] * abs(1 - share / mean_depth) + w[1] * (1 - density[name]) + w[2] * abs(mean_gc - gc_of[name]) if mean_depth > 0 else float("inf")
                    if score <= rules.max_score and total + more <= rules.max_length and mean_depth > 0:
                        options.append((score, me, side, name, way, pair, seen))
            if not options:
                break
            score, me, side, name, way, pair, seen = min(options)
            if rules.by_segment and seen:
                ring = True
                continue
            used.add(pair)
            gaps[fresh] = (0, 0) if genes[name] else (gaps[me][0] + length[name], gaps[me][1] + 1)
            scores[fresh] = score
            at = len(chain) if side else 0
            chain.insert(at, (name, way))
            ids.insert(at, fresh)
            fresh += 1
        if not rules.by_segment and len(chain) > 1 and chain[0] == chain[-1]:
            first, last = ids[0], ids[-1]
            goes = 0 if last == 0 or (first != 0 and scores[first] >= scores[last]) else -1
            chain.pop(goes), ids.pop(goes)
            ring = True
        names = Counter(n for n, _ in chain)
        whole = depth_of(chain, names) if not rules.by_segment else depth_of(chain, Counter(dict.fromkeys(names, 1)))
        took = [(n, o, min(left_over[n] / names[n], whole)) for n, o in chain]
        out.append((stack[0], took, ring))
        for n, _, d in took:
            left_over[n] -= d
        kept = [s for s in stack if left_over[s] > least]
        stack = kept if len(kept) < len(stack) or whole > 1e-9 else stack[1:]
    return out


RULES = [
    P.Growth(max_gc_diff=0.4), P.Growth(max_score=1.2, max_length=300, max_gc_diff=0.25, max_gap_nt=40, max_gap_segments=1), P.Growth(max_gc_diff=1, weights=(1.0, 0.5, 2.0), use_median=True),
    P.Growth(max_gc_diff=0.5, by_segment=True), P.Growth(max_score=2, max_gc_diff=0.3, max_gap_nt=50, max_gap_segments=0, by_segment=True, weights=(0.2, 1.0, 0.0)),
]


@pytest.mark.parametrize("which", range(len(RULES)))
def test_growth_follows_its_rules(spark, which):
    rng, rules = random.Random(100 + which), RULES[which]
    seg, link, dens, n = [], [], [], 22
    for sample in (1, 2, 3, 4):
        seg += [(sample, f"n{i:02}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 60))), None, None, round(rng.random() * 3, 3)) for i in range(n)]
        link += [(sample, f"n{rng.randrange(n):02}", rng.choice("+-"), f"n{rng.randrange(n):02}", rng.choice("+-"), "5M") for _ in range(32)]
        dens += [(sample, f"n{i:02}", round(rng.random(), 2), rng.random() < 0.6) for i in range(n) if rng.random() < 0.9]
    segments, links, densities = spark.createDataFrame(seg, SEG), spark.createDataFrame(link, LINK), spark.createDataFrame(dens, DENS)
    got = defaultdict(list)
    for r in P.grow(segments, links, densities, rules, min_density=0.4).collect():
        got[r.sample_id, r.plasmid_no].append((r.pos, r.seg_name, r.orientation, round(r.depth, 9), r.seed, r.circular))
    found = sorted((s, rows[0][4], tuple((n, o, d) for _, n, o, d, _, _ in sorted(rows)), rows[0][5]) for (s, _), rows in got.items())
    known = {(s, n): (d, g) for s, n, d, g in dens}
    expected = []
    for sample in (1, 2, 3, 4):
        gc = lambda q: sum(c in "GC" for c in q) / len(q)
        facts = {n: (len(q), d, gc(q), *known.get((sample, n), (0.0, False))) for s, n, q, _, _, d in seg if s == sample}
        least = 0.3 * median([(f[1], f[0]) for f in facts.values()])
        deep = densities.filter(densities.sample_id == sample).join(segments.filter(segments.depth >= least).select("sample_id", "seg_name"), ["sample_id", "seg_name"], "left_semi")
        order = G.seeds(segments, links, deep, min_depth=0.0, min_density=0.4, max_length=500_000).orderBy("place").collect()
        grown = model(facts, [x[1:5] for x in link if x[0] == sample], [r.seg_name for r in order], least, rules)
        expected += [(sample, seed, tuple((n, o, round(d, 9)) for n, o, d in took), ring) for seed, took, ring in grown]
    assert len(found) > 20 and found == sorted(expected)


def branching(facts, links, seed, least, rules):
    """The first candidate of a graph with a fan-out above 1: names and ways in the order in which they were added."""
    after, before = defaultdict(set), defaultdict(set)
    for a, x, b, y in links:
        for h, t in (((a, x), (b, y)), ((b, OTHER[y]), (a, OTHER[x]))):
            after[h].add(t)
            before[t].add(h)
    members, open_sides, used = [(seed, "+")], [{"l", "r"}], set()
    while True:
        names, total = Counter(n for n, _ in members), sum(facts[n][0] for n, _ in members)
        depth = sum(facts[n][1] / names[n] * facts[n][0] for n, _ in members) / total
        gc = sum(facts[n][2] * facts[n][0] for n, _ in members) / total
        options = []
        for i, (n, o) in enumerate(members):
            if len(members) > 1 and len(open_sides[i]) != 1:
                continue
            for side in sorted(open_sides[i]):
                for m, w in (before if side == "l" else after)[n, o]:
                    pair = ((m, w), (n, o)) if side == "l" else ((n, o), (m, w))
                    mirror = tuple((x, OTHER[y]) for x, y in reversed(pair))
                    share = facts[m][1] / (names[m] + 1)
                    if pair in used or mirror in used or share < least or abs(gc - facts[m][2]) > rules.max_gc_diff or total + facts[m][0] > rules.max_length:
                        continue
                    options.append((abs(1 - share / depth) + 1 - facts[m][3] + abs(gc - facts[m][2]), i, side, m, w, pair))
        if not options:
            return members
        for _, i, side, m, w, pair in sorted(options)[: rules.fan_out]:
            members.append((m, w))
            open_sides[i].discard(side)
            open_sides.append({side})
            used.add(pair)


def test_growth_with_a_fan_out(spark):
    rng = random.Random(77)
    rules, n = P.Growth(max_gc_diff=0.3, max_gap_nt=10**9, max_length=500, fan_out=2), 25
    seg = [(1, f"n{i:02}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 60))), None, None, round(1 + rng.random() * 3, 3)) for i in range(n)]
    link = [(1, f"n{rng.randrange(n):02}", rng.choice("+-"), f"n{rng.randrange(n):02}", rng.choice("+-"), "5M") for _ in range(45)]
    dens = [(1, f"n{i:02}", round(rng.random(), 2), True) for i in range(n)]
    segments, links, densities = spark.createDataFrame(seg, SEG), spark.createDataFrame(link, LINK), spark.createDataFrame(dens, DENS)
    got = P.grow(segments, links, densities, rules, min_density=0.4).filter("plasmid_no = 0").orderBy("pos").collect()
    facts = {m: (len(q), d, sum(c in "GC" for c in q) / len(q), dens[i][2]) for i, (_, m, q, _, _, d) in enumerate(seg)}
    least = 0.3 * median([(f[1], f[0]) for f in facts.values()])
    expected = branching(facts, [x[1:5] for x in link], got[0].seed, least, rules)
    assert len(got) > 5 and [(r.seg_name, r.orientation) for r in got] == expected
    whole = P.collection_facts(P.grow(segments, links, densities, rules, min_density=0.4), segments, densities).filter("plasmid_no = 0").first()
    assert whole.length == sum(facts[m][0] for m, _ in expected) and whole.n_members == len(expected)
