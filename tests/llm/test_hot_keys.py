"""Copies that hold a third of all rows are dealt over the tasks, and results stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import jaccard, repair
from spindrift.operators import scans

WORDS = [f"word{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_equal_rows_lie_in_many_shards(spark):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    same = prose(rng, 9)
    rows = [(7, same)] * 1500 + [(i, prose(rng, 9)) for i in range(100, 3100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shards = repair.write_shards(df, repair.default_tokenizer(), shard=400, partitions=8)
    sizes = sorted(r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * (sizes[3] + sizes[4]) / 2
    got = repair.read_shards(shards)
    assert got.count() == 4500 and got.where("doc_id = 7").count() == 1500 and got.where("doc_id = 7").select("ids_crc32").distinct().count() == 1
    # starts follow the ids in order
    ends = [(r.start, r.n_tokens, r.doc_id) for r in got.orderBy("start").collect()]
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("least", [5, 10**6])
def test_copies_by_broadcast_or_shuffle(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard, "lookup", lambda *a, **k: scans.lookup(*a, **k, least=least))
    rng = random.Random(2)
    hot, near = prose(rng, 60), prose(rng, 60)
    rows = [(i, hot) for i in range(40)] + [(3, hot)] * 30 + [(100 + i, near.replace("word7", f"word{i}")) for i in range(10)] + [(200 + i, prose(rng, 40)) for i in range(20)] + [(300, None), (300, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_report(df)
    assert got.count() == len(rows) and got.where("component_id = 0").count() == 70
    kept = [r.doc_id for r in jaccard.keep_one(df).collect()]
    assert sorted(i for i in kept if i is not None and i < 100) == [0] and kept.count(300) == 2 and kept.count(None) == 1
    assert len([i for i in kept if i is not None and 200 <= i < 300]) == 20
