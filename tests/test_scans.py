"""Scans and lookups against plain Python, with one group that holds most rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import scans
from spindrift.tables import cut


def rows(seed=3):
    rng = random.Random(seed)
    out = [("hot", i, rng.randrange(9)) for i in range(900)]
    out += [(f"k{i % 40}", i, rng.choice([None, 1, 2])) for i in range(300)] + [(None, i, 5) for i in range(20)]
    rng.shuffle(out)
    return out


def wanted(data):
    out = []
    key = lambda r: (r[0] is None, r[0] or "")
    for _, g in itertools.groupby(sorted(data, key=lambda r: (key(r), r[1])), key=key):
        total, last = 0, None
        for place, (k, o, v) in enumerate(g):
            total += v or 0
            out.append((k, o, v, total, last, place))
            last = o
    return sorted(out, key=str)


def test_running_over_a_hot_group(spark):
    df = spark.createDataFrame(rows(), "k string, o long, v long").repartition(7)
    got = scans.running(df, ["k"], ["o"], {"total": F.col("v")}, {"last": F.col("o")}, place="place")
    assert sorted((tuple(r) for r in got.select("k", "o", "v", "total", "last", "place").collect()), key=str) == wanted(rows())
    assert scans.running(df.where("false"), ["k"], ["o"], {"total": F.col("v")}, place="place").count() == 0
    # the hot group lies in several sorted parts, none of which is most of it
    spread = df.repartitionByRange(8, "k", "o").withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count()
    assert spread.agg(F.max("count")).first()[0] < 450


def test_by_place_in_blocks(spark):
    want = wanted(rows())
    df = cut(spark.createDataFrame([(k, o, v, p) for k, o, v, _, _, p in want], "k string, o long, v long, place long"))
    got = scans.by_place(df, ["k"], "place", {"total": F.col("v")}, {"last": F.col("o")}, block=64)
    assert sorted(((r.k, r.o, r.v, r.total, r.last, r.place) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("least", [5, 10**6])
def test_lookup(spark, least):
    big = cut(spark.createDataFrame([(k, o) for k, o, _ in rows()], "k string, o long"))
    small = cut(spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, x int"))
    have = {"hot": 1, "k1": 2}
    for how in ("inner", "left"):
        got = scans.lookup(big, small, "k", how, heavy=16, least=least)
        assert sorted((tuple(r) for r in got.select("k", "o", "x").collect()), key=str) == sorted([(k, o, have.get(k)) for k, o, _ in rows() if how == "left" or k in have], key=str)
