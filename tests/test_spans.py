"""Joins in time against plain comparison of all pairs, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import spans


def moments(seed, n=500):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
    return [(key(), rng.choice([None, *range(200)]) if rng.random() < 0.1 else rng.randrange(200), i) for i in range(n)]


@pytest.mark.parametrize("inner", [False, True])
def test_as_of(spark, inner):
    left, right = moments(1), moments(2, 300)
    a, b = spark.createDataFrame([*left, left[0]], "k string, t long, `a.b` long").repartition(5), spark.createDataFrame(right, "k string, t long, i long").repartition(3)
    want = []
    for k, t, i in [*left, left[0]]:
        now = max(((s, j) for q, s, j in right if q == k and k is not None and s is not None and t is not None and s <= t), default=None)
        if now or not inner:
            want.append((k, t, i, now and now[1]))
    got = spans.as_of(a, b, ["k"], "t", "t", "i", inner)
    assert got.columns == ["k", "t", "a.b", "found"]
    assert sorted(map(str, [(r[0], r[1], r[2], r.found and r.found.i) for r in got.collect()])) == sorted(map(str, want))


def test_as_of_of_nothing(spark):
    a, b = spark.createDataFrame(moments(1, 20), "k string, t long, i long"), spark.createDataFrame([], "k string, t long, i long")
    assert spans.as_of(a, b, ["k"], "t", "t", "i").where("found is null").count() == 20
    assert spans.as_of(b, a, ["k"], "t", "t", "i").count() == 0


def periods(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(-500, 5000)
        long = rng.choice([0, 1, 2, 5, 64, 1000, 4096, -3])
        out.append(("hot" if rng.random() < 0.7 else rng.choice(["a", None]), s, None if rng.random() < 0.03 else s + rng.randrange(long + 1) if long > 0 else s + long, i))
    return out


def test_overlaps(spark):
    left, right = periods(1, 200), periods(2, 150)
    kind = "k string, s long, e long, i long"
    a, b = spark.createDataFrame([*left, ("hot", 7, 9, 900), ("hot", 7, 9, 900)], kind), spark.createDataFrame([*right, ("hot", 7, 9, 901)], kind)
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] < r[2]
    want = [(x[3], y[3]) for x in [*left, ("hot", 7, 9, 900), ("hot", 7, 9, 900)] if ok(x) for y in [*right, ("hot", 7, 9, 901)] if ok(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    got = spans.overlaps(a, b, ["k"], "s", "e")
    assert sorted((r.a.i, r.b.i) for r in got.collect()) == sorted(want)
    assert spans.overlaps(a, b.where("false"), ["k"], "s", "e").count() == 0 == spans.overlaps(a.where("false"), b, ["k"], "s", "e").count()


def test_overlaps_compare_no_pairs(spark, capsys):
    """No nested loop in the plan, and as many rows leave the joins as there are results."""
    a = spark.createDataFrame(periods(1, 50), "k string, s long, e long, i long")
    spans.overlaps(a, a, ["k"], "s", "e").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pieces_cover_a_period_once(spark):
    rows = [(s, s + n) for s in (-9, 0, 1, 5, 1023, 1024) for n in (1, 2, 3, 7, 8, 100, 1024)]
    got = spark.createDataFrame(rows, "s long, e long").select("s", "e", spans.pieces(F.col("s"), F.col("e"), 12).alias("p")).collect()
    for r in got:
        held = [m for p in r.p for m in range(p.node << p.level, (p.node + 1) << p.level)]
        assert sorted(held) == list(range(r.s, r.e))
