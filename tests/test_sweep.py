import random

from ringweave.operators.sweep import pair_stretches, periods_and_gaps

SCHEMA = "k string, a int, b int, kind string, __from0 int"


def brute(data):
    """Marks every position of each entity."""
    out = set()
    for key in {k for k, a, b in data}:
        marked = set()
        for k, a, b in data:
            if k == key and a is not None and b is not None:
                marked |= set(range(min(a, b), max(a, b) + 1))
        if not marked:
            continue
        at, kind = min(marked), "period"
        for pos in range(min(marked), max(marked) + 2):
            now = "period" if pos in marked else "gap"
            if now != kind or pos == max(marked) + 1:
                out.add((key, kind, at, pos - 1))
                at, kind = pos, now
    return out


def found(spark, data, **how):
    df = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)
    return {(r.k, r.kind, r.pos_from, r.pos_to) for r in periods_and_gaps(df, ["k"], {"": ("a", "b")}, **how).collect()}


def sample():
    rng = random.Random(5)
    data = [(rng.choice("pqr"), a := rng.randrange(1, 400), a + rng.randrange(-15, 25)) for _ in range(150)]
    data += [("h", a := rng.randrange(1, 900), a + rng.randrange(0, 9)) for _ in range(120)]
    return data + [(None, 3, 5), (None, 9, 9), ("n", None, 4), ("n", 4, None)] + data[:20]


def test_whole_entities(spark):
    assert found(spark, sample()) == brute(sample())


def test_hot_entities_in_blocks(spark):
    assert found(spark, sample(), hot_rows=5, block=16) == brute(sample())
    assert found(spark, sample(), hot_rows=100, block=7) == brute(sample())


def test_touching_nested_and_extreme(spark):
    data = [("x", 1, 5), ("x", 6, 9), ("x", 2, 3), ("y", 2147483647, 2147483640), ("z", -5, 5)]
    expected = {("x", "period", 1, 9), ("y", "period", 2147483640, 2147483647), ("z", "period", -5, 5)}
    assert found(spark, data) == expected == found(spark, data, hot_rows=0, block=4)


def test_empty(spark):
    assert found(spark, []) == set()


def test_pairs_and_sides(spark):
    df = spark.createDataFrame(
        [("g", "s", 1, 5, 30, 20, 0), ("g", "s", 8, 9, None, 4, 0), ("g", "g", 2, 2, 7, 7, 1)], "qseqid string, sseqid string, qstart int, qend int, sstart int, send int, side int"
    )
    got = {tuple(r) for r in pair_stretches(df).collect()}
    assert got == {
        ("g", "s", "q", "period", 1, 5), ("g", "s", "q", "gap", 6, 7), ("g", "s", "q", "period", 8, 9), ("g", "s", "s", "period", 20, 30), ("g", "g", "q", "period", 2, 2), ("g", "g", "s", "period", 7, 7)
    }
    assert [f.dataType.simpleString() for f in pair_stretches(df).schema][-2:] == ["int", "int"]


def test_more_hot_entities_than_are_sent(spark, monkeypatch):
    from ringweave.operators import sweep

    monkeypatch.setattr(sweep, "MOST_SENT", 0)
    assert found(spark, sample(), hot_rows=5, block=16) == brute(sample())
