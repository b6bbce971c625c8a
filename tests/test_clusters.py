"""The clustered search gives the rows of the plain one and skips most of the vectors where they lie in clusters."""

import numpy as np
import pytest

from spindrift.operators import clusters, retrieval


def vectors(seed=1, n=1500, dims=16, unit=True, near=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(30, dims))
    v = c[rng.integers(0, 30, n)] + near * rng.normal(size=(n, dims))
    if unit:
        v /= np.sqrt((v * v).sum(1, keepdims=True))
    return v


def frame(spark, v, extra=()):
    return spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *extra], "i long, v array<double>").repartition(4)


@pytest.mark.parametrize(("unit", "near", "k"), [(True, 0.05, 10), (False, 0.05, 10), (True, 5.0, 3), (True, 0.05, 1400), (False, 0.0, 7)])
def test_same_rows_as_the_plain_search(spark, tmp_path, monkeypatch, unit, near, k):
    monkeypatch.setattr(clusters, "QUERIES", 30)  # blocks of queries
    v = vectors(unit=unit, near=near)
    items = frame(spark, v, [(9000, None), (9001, []), (9002, v[3].tolist())])
    q = items.where("i % 20 = 0")
    index = clusters.Clusters.build(items, "i", "v", f"file://{tmp_path}/c", sample=500)
    got, met, whole = index.search(q, "i", "v", k)
    key = lambda r: (r.query, r["rank"], r.item, round(r.score, 8))
    plain = retrieval.dense(q.where("size(v) > 0"), items.where("size(v) > 0"), k, "i", "i", "v")
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert whole == q.where("size(v) > 0").count() * 1501 and met <= whole
    if near == 0.05 and k == 10 and unit:
        assert met < 0.25 * whole


def test_nothing_to_search(spark, tmp_path):
    empty = spark.createDataFrame([], "i long, v array<double>")
    index = clusters.Clusters.build(empty, "i", "v", f"file://{tmp_path}/c")
    assert index.search(frame(spark, vectors(n=3)), "i", "v", 2)[0].count() == 0
    full = clusters.Clusters.build(frame(spark, vectors(n=3)), "i", "v", f"file://{tmp_path}/d")
    assert full.search(empty, "i", "v", 2)[0].count() == 0
