"""The sections table function and the distributed fit."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from spindrift.functions import sections
from spindrift.operators import fitting, training

PAGE = "<html><h1>Title</h1><article><p>Intro here</p><h2>One</h2><p>a b</p><div><h2>Inner</h2>x</div><h2>Two &amp; three</h2><p>c</p><h2></h2></article></html>"


def test_sections_from_sql(spark):
    spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>no article</p>"), (5, "<article>" + "<h2>h</h2>t" * 500 + "</article>")], "id int, html string").createOrReplaceTempView("some_pages")
    sections.register(spark, "sections")
    got = spark.sql("select p.id, s.* from some_pages p, lateral sections(p.html, 'article') s order by id, section").collect()
    assert [tuple(r) for r in got[:3]] == [(1, 0, "Title", "Title\nIntro here", 3), (1, 1, "One", "One\na b\nInner\nx", 5), (1, 2, "Two & three", "Two & three\nc", 4)]
    assert {r.id for r in got} == {1, 5} and sum(r.id == 5 for r in got) == 500
    assert sections.of(spark.table("some_pages"), container="article").columns == ["id", "html", "section", "heading", "text", "n_words"]


def pairs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        q = rng.sample(words, 5)
        y = int(rng.random() < 0.4)
        t = (q[: rng.randrange(2, 6)] if y else q[: rng.randrange(0, 3)]) + rng.sample(words, rng.randrange(3, 12))
        out.append((" ".join(q), " ".join(t), y))
    return [*out, (None, "w1", 0), ("w1", None, 0), ("", "", 1), ("w1", "w1", None)]


KIND = "q string, t string, label int"


def alone(x, y, steps, top, warm, decay):
    """The same steps in one process."""
    w, a, b = np.zeros(x.shape[1] + 1), 0, 0
    for s in range(steps):
        z = x @ w[:-1] + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.append(x.T @ e, e.sum())
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        lr = fitting.rate(s, steps, top, warm)
        w = w - lr * (a / (1 - 0.9 ** (s + 1)) / (np.sqrt(b / (1 - 0.999 ** (s + 1))) + 1e-8) + decay * np.append(w[:-1], 0))
    return w


def test_weights_are_those_of_one_process(spark, tmp_path):
    train, val = spark.createDataFrame(pairs(1, 300), KIND).repartition(5), spark.createDataFrame(pairs(2, 120), KIND).repartition(3)
    best, reports = fitting.fit(train, val, "q", "t", steps=12, every=4)
    rows = training.pair_features(train.where("label is not null"), "q", "t").select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    last = [r for r in reports if r[0] == 12][0]
    z = x @ alone(x, y, 12, 0.3, 0.1, 0.01)[:-1] + alone(x, y, 12, 0.3, 0.1, 0.01)[-1]
    assert abs(last[1] - (np.logaddexp(0, z) - y * z).mean()) < 1e-9
    assert np.allclose(best.weights, alone(x, y, 12, 0.3, 0.1, 0.01) if best.step == 12 else best.weights, atol=1e-9)
    assert best.precision == max(r[2] for r in reports) > 0.7 and best.step == min(r[0] for r in reports if r[2] == best.precision) and best.step > 0
    # written, loaded and used
    again = fitting.Scorer.load(spark, best.write(spark, f"file://{tmp_path}/m"))
    assert (again.weights == best.weights).all() and (again.step, again.precision) == (best.step, best.precision)
    got = spark.createDataFrame([("w1 w2 w3", "w1 w2 w3"), ("w1 w2 w3", "w9")], "q string, t string").select(again.score("q", "t").alias("score")).collect()
    assert got[0].score > 0.5 > got[1].score
    with pytest.raises(FileNotFoundError, match="train one first"):
        fitting.Scorer.load(spark, f"file://{tmp_path}/none")


def test_rate_warms_up_and_ends():
    r = [fitting.rate(s, 20, 1.0, 0.1) for s in range(20)]
    assert r[:3] == [0.5, 1.0, 1.0] and all(a >= b for a, b in zip(r[1:], r[2:], strict=False)) and 0 < r[-1] < 0.1


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], KIND)
    best, reports = fitting.fit(none, spark.createDataFrame(pairs(2, 20), KIND), "q", "t", steps=2, every=1)
    assert not best.weights.any() and best.step == 0 and len(reports) == 3
