import random
import re
from collections import defaultdict

import pytest

from ringweave.llm.groups import linked_groups
from ringweave.llm.spans import shared_spans, span_clusters


def union_find(pairs):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        up.setdefault(a, a), up.setdefault(b, b)
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def pairs_of_all_shapes():
    rng = random.Random(1)
    pairs = [(f"chain{i:03}", f"chain{i + 1:03}") for i in range(120)]
    pairs += [(f"ring{i:02}", f"ring{(i + 1) % 30:02}") for i in range(30)]
    pairs += [("hub", f"leaf{i}") for i in range(300)]
    pairs += [(f"d{rng.randrange(40)}", f"d{rng.randrange(40)}") for _ in range(300)]
    pairs += [(f"s{rng.randrange(200)}", f"s{rng.randrange(200)}") for _ in range(150)]
    return pairs + [("b", "a"), ("a", "b"), ("only", "only"), (None, "x"), ("x", None), ("é", "z"), ("K4a", "K4b"), ("K4a", "K4c"), ("K4a", "K4d"), ("K4b", "K4c"), ("K4b", "K4d"), ("K4c", "K4d")]


@pytest.mark.parametrize("share", [0.05, 0.9])
def test_groups_of_all_shapes(spark, share):
    pairs = pairs_of_all_shapes()
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in pairs], "l string, r string, v string, label string")
    got = linked_groups(df, "l", "r", least_share=share).collect()
    assert len(got) == len({r.seq_id for r in got})
    assert {r.seq_id: r.group_id for r in got} == union_find(pairs)


def test_no_links(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b")], "l string, r string")
    assert linked_groups(df, "l", "r").collect() == []
    assert linked_groups(df.filter("false"), "l", "r").columns == ["seq_id", "group_id"]


def letters(seq):
    return re.sub("[^A-Z]", "", re.sub("[a-z]", lambda m: m[0].upper(), seq or ""))


def spans_by_windows(rows, size):
    seqs = defaultdict(list)
    for number, seq in rows:
        if number is not None:
            seqs[number].append(letters(seq))
    owners = defaultdict(set)
    for number, all_of_it in seqs.items():
        for s in all_of_it:
            for i in range(len(s) - size + 1):
                if re.fullmatch("[ACGT]+", s[i : i + size]):
                    owners[s[i : i + size]].add(number)
    out = set()
    for number, all_of_it in seqs.items():
        covered = set()
        for s in all_of_it:
            for i in range(len(s) - size + 1):
                if len(owners.get(s[i : i + size], ())) > 1:
                    covered |= set(range(i + 1, i + size + 1))
        at = None
        for pos in sorted(covered):
            if pos - 1 not in covered:
                at = pos
            if pos + 1 not in covered:
                out.add((number, at, pos))
    return out


def sequence_rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(50, 700))) for _ in range(25)]
    rows = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(len(a))
        s = a[cut:] + b[: rng.randrange(len(b))]
        if i % 3 == 0:
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice("NacgtRY- \n") + s[at:]
        rows.append((i, s.lower() if i % 4 == 0 else s))
    rows += [(100, "A" * 400 + "C" * 90), (101, "A" * 150 + "G"), (102, "ACGT" * 80), (103, "CGTA" * 40 + "n" + "CGTA" * 16), (104, None), (105, ""), (106, "-"), (107, "*"), (None, base[0])]
    return rows + [(108, base[1]), (108, base[1]), (109, "ß" + base[2] + "é"), (110, "G" * 59), (111, "T" * 30_000)]


@pytest.mark.parametrize("size,hot", [(24, 100_000), (31, 5), (60, 100_000), (60, 2), (64, 0), (65, 100_000), (100, 3), (300, 100_000)])
def test_spans(spark, size, hot):
    rows = sequence_rows()
    df = spark.createDataFrame([(n, s, 7, "x") for n, s in rows], "number long, s string, start int, band string")
    got = [tuple(r) for r in shared_spans(df, "number", "s", span=size, hot_rows=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == spans_by_windows(rows, size)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_clusters(spark, hot):
    rows = [(1, "ACGGT" * 20), (2, "TT" + "ACGGT" * 20), (3, "GGC" * 30 + "ACGGT" * 14), (4, "GGC" * 30), (5, "CATTG" * 30), (6, "CATTG" * 30), (7, "A" * 10)]
    got = {r.ref_no: r.cluster for r in span_clusters(spark.createDataFrame(rows, "n long, s string"), "n", "s", hot_rows=hot).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_clusters_of_many_records(spark):
    rows = sequence_rows()
    spans = defaultdict(set)
    for number, seq in rows:
        for i in range(len(letters(seq)) - 59):
            if number is not None and re.fullmatch("[ACGT]+", letters(seq)[i : i + 60]):
                spans[letters(seq)[i : i + 60]].add(number)
    expected = union_find([(min(x), y) for x in spans.values() for y in x if y != min(x)])
    got = span_clusters(spark.createDataFrame(rows, "n long, s string"), "n", "s").collect()
    assert len(got) == len(expected) and {r.ref_no: r.cluster for r in got} == expected


def test_no_sequences(spark):
    empty = spark.createDataFrame([], "n long, s string")
    assert shared_spans(empty, "n", "s").collect() == []
    with pytest.raises(ValueError):
        shared_spans(empty, "n", "s", span=10)
