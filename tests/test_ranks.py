"""Percentiles and grouping sets against plain computation, with one group that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import chunking, evaluation, ranks, scans


def rows(seed=1):
    rng = random.Random(seed)
    out = [("hot", round(rng.gauss(0, 9), 1)) for _ in range(3000)] + [("one", 4.5), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 8.0), ("empty", None)]
    return [*out, *(("hot", None) for _ in range(5)), *(("same", 3.25) for _ in range(50))]


@pytest.mark.parametrize("least", [scans.LEAST, 10])
def test_percentiles(spark, monkeypatch, least):
    """The group's size reaches its values by a shuffle, or for hot groups by a broadcast."""
    monkeypatch.setattr(ranks, "lookup", lambda *a, **k: scans.lookup(*a, **k, least=least))
    shares = {"low": 0.0, "p37": 0.37, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.k: tuple(r)[1:] for r in ranks.percentiles(spark.createDataFrame(rows(), "k string, v double").repartition(6), ["k"], "v", shares).collect()}
    assert set(got) == {"hot", "one", "two", None, "same"}
    for k, (n, *have) in got.items():
        v = [x for q, x in rows() if q == k and x is not None]
        assert n == len(v) and np.allclose(have, np.percentile(v, [100 * p for p in shares.values()]), atol=1e-12)


def test_no_task_holds_the_hot_group(spark):
    """Distinct values of one group are dealt over all tasks of the sort: the largest has less than twice its share."""
    df = spark.createDataFrame([("hot", float(i)) for i in range(8000)], "k string, v double")
    parts = df.repartitionByRange(8, "k", "v").withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 2 * 8000 / 8


def test_semantic_groups_of_a_giant_label(spark, capsys):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    df = spark.createDataFrame([("hot" if i < 590 else "few", i, v[i].tolist()) for i in range(600)], "g string, i long, v array<double>").repartition(5)
    got = {r.i: r.part for r in chunking.semantic_groups(df, "g", "i", "v").collect()}
    for a, b in ((0, 590), (590, 600)):
        gap = 1 - (v[a : b - 1] * v[a + 1 : b]).sum(1)
        part = np.concatenate([[0], np.cumsum(gap > np.percentile(gap, 90))])
        assert [got[i] for i in range(a, b)] == part.tolist()
    # a window is over parts of a group, or over the parts' last rows
    chunking.semantic_groups(df, "g", "i", "v").explain()
    windows = [line for line in capsys.readouterr().out.splitlines() if " Window [" in line]
    assert windows and all("_scan_p" in line for line in windows)


def test_average_precision_of_one_group(spark):
    rng = random.Random(5)
    data = [("g", i, rng.choice([None, 1.0, 2.0, 3.0]), int(rng.random() < 0.3)) for i in range(500)] + [("none", 1, 1.0, 0)]
    got = {r.g: r for r in evaluation.average_precision(spark.createDataFrame(data, "g string, i long, s double, y int").repartition(4), "g", "i", "s", "y").collect()}
    order = sorted((d for d in data if d[0] == "g"), key=lambda d: (d[2] is None, -(d[2] or 0), d[1]))
    hits, total = 0, []
    for place, d in enumerate(order, 1):
        if d[3]:
            hits += 1
            total.append(hits / place)
    assert abs(got["g"].average_precision - sum(total) / len(total)) < 1e-12 and got["g"].positives == hits
    assert got["none"].average_precision == 0 and got["none"].positives == 0


def test_grouped_metrics(spark):
    data = [("a", "x", 1), ("a", "y", None), ("b", "x", 4), (None, "x", 2)]
    df = spark.createDataFrame(data, "d string, e string, r int")
    got = {(r.d, r.e, r.level): (r.n, r.recall_at_1, r.recall_at_5, r.mrr) for r in evaluation.grouped_metrics(df, "r", ["d", "e"]).collect()}
    assert got[("a", None, 1)] == (2, 1, 1, 0.5) and got[(None, "x", 2)] == (3, 1, 3, round((1 + 1 / 4 + 1 / 2) / 3, 4))
    assert got[(None, "x", 0)] == (1, 0, 1, 0.5) and got[(None, None, 1)] == (1, 0, 1, 0.5) and got[(None, None, 3)] == (4, 1, 3, 0.4375)
    assert evaluation.grouped_metrics(df, "r", ["d"], totals=False).count() == 3
