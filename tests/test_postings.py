"""The stored index against the plain BM25 ranking, with ties, short lists and skipped blocks."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import postings, retrieval

WORDS = [f"w{i}" for i in range(60)]


def docs(seed=1, n=900):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(WORDS[: 5 + rng.randrange(55)]) for _ in range(rng.randrange(1, 30)))) for i in range(n)]
    # a few items hold a rare word often: their blocks' bounds stand out
    out += [(n + i, "rare " * (1 + i % 3) + "w1") for i in range(6)]
    return [*out, (5000, None), (5001, ""), (7, "w1 w2"), (9999, "common " * 3)]


def questions():
    return [(1, "rare w1"), (2, "w3 w4 w5"), (3, None), (4, "unknown words"), (5, "w0 w0 w59"), (6, "common"), (7, "w0")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = spark.createDataFrame([r for r in docs() if r != (7, "w1 w2")], "item long, text string").repartition(4)
    path = f"file://{tmp_path_factory.mktemp('postings')}/i"
    return d, postings.Postings.build(postings.token_counts(d, "item", "text"), postings.lengths(d, "item", "text"), path, "v1", block=32)


@pytest.mark.parametrize("k", [1, 5, 700, 2000])
def test_same_ranks_as_without_an_index(spark, built, k):
    d, index = built
    q = spark.createDataFrame(questions(), "id long, text string")
    plain = retrieval.Lexical(d, "item", "text").top(q, "id", "text", k)
    key = lambda r: (r.query, r["rank"], r.item, round(r.score, 7))
    assert sorted(map(key, index.top(q, "id", "text", k).collect())) == sorted(map(key, plain.collect()))


def test_idf_and_pushed_terms(spark, built, monkeypatch):
    d, index = built
    want = {r.term: (r.df, round(r.idf, 9)) for r in retrieval.Lexical(d, "item", "text").idf.collect()}
    assert {r.term: (r.df, round(r.idf, 9)) for r in index.idf.collect()} == want
    q = spark.createDataFrame(questions(), "id long, text string")
    few = sorted(map(str, index.top(q, "id", "text", 3).collect()))
    monkeypatch.setattr(postings, "PUSHED", 2)
    monkeypatch.setattr(postings, "WEIGHTS", 8)  # several batches of queries
    assert sorted(map(str, index.top(q, "id", "text", 3).collect())) == few


def test_blocks_are_skipped(spark, built):
    """A question with a rare word reads the few blocks that hold it, not those of its common word."""
    _, index = built
    q = spark.createDataFrame([(1, "rare w1")], "id long, text string")
    hits, used = index.search(q, "id", "text", 3)
    assert {r.item for r in hits.collect()} <= set(range(900, 906))
    terms = index.read("postings").where(F.col("term").isin("rare", "w1"))
    assert used.agg(F.sum("n")).first()[0] < terms.agg(F.sum("n")).first()[0] / 2


def test_versions(spark, built, tmp_path):
    d, _ = built
    path = f"file://{tmp_path}"
    a = postings.Postings.current(d, "item", "text", path, "a")
    # the stored index answers, though the corpus handed in has changed
    assert postings.Postings.current(d.limit(3), "item", "text", path, "a").n == a.n == d.count()
    b = postings.Postings.current(d.where("item < 5"), "item", "text", path, "b")
    assert b.n == 5 and postings.Postings.open(spark, f"{path}/a", "a").n == a.n
    with pytest.raises(ValueError, match="of version"):
        postings.Postings.open(spark, f"{path}/a", "b")
    with pytest.raises(FileNotFoundError):
        postings.Postings.open(spark, f"{path}/c")


def test_empty_corpus(spark, tmp_path):
    d = spark.createDataFrame([], "item long, text string")
    index = postings.Postings.build(postings.token_counts(d, "item", "text"), postings.lengths(d, "item", "text"), f"file://{tmp_path}/e")
    assert index.top(spark.createDataFrame(questions(), "id long, text string"), "id", "text", 3).count() == 0
