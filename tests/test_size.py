"""Steps whose memory, shuffles or passes over the texts grew with the input more than they need."""

import re

import numpy as np
import pyarrow as pa
import pytest

from spindrift import catalogue, catalogue_more, tables
from spindrift.functions.runs import runs
from spindrift.operators import evaluation, postings, retrieval
from spindrift.plans import config, pipeline
from spindrift.sources import corpus

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_tokens_agree_with_the_pattern():
    texts = ["ab1 c", None, "", "d", "é x-y", "  ", "z", "一a一", "end"]
    for lo, a in ((0, pa.array(texts, pa.string())), (2, pa.array(texts, pa.string())), (0, pa.array(texts, pa.large_string())), (0, pa.array([None, ""], pa.string())), (0, pa.array([], pa.string()))):
        size, tokens = runs(a.slice(lo))
        want = [re.findall("[a-z0-9]+", t or "") for t in a.slice(lo).to_pylist()]
        assert size.tolist() == [len(w) for w in want] and tokens.to_pylist() == [t for w in want for t in w]


def test_texts_are_normalised_once(spark):
    p = spark.createDataFrame([(1, "one two three")], "p long, passage string")
    t = spark.createDataFrame([(7, "Zero, ONE two; three!")], "t long, body string")
    got = evaluation.containment(p, t, "p", "passage", "t", "body")
    assert "body" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 7)]


def test_chunks_keep_their_address_without_a_join(spark):
    a = spark.createDataFrame([("s", "u", "", "", "a b c d e")], "slug string, source_url string, title string, summary string, body_text string")
    for way in ("fixed", "small_to_big"):
        cfg = config.Config(chunk=config.Chunk(strategy=way, size_tokens=4, overlap_tokens=1, child_size_tokens=2, child_overlap_tokens=0))
        for df in pipeline.chunks(cfg, a):
            assert df is None or ("Join" not in plan(df) and {r.source_url for r in df.collect()} == {"u"})


def test_terms_are_counted_without_a_shuffle(spark):
    d = spark.createDataFrame([(1, "B a b"), (2, None)], "i long, t string")
    got = postings.token_counts(d, "i", "t")
    assert "Exchange" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2)]
    assert sorted(tuple(r) for r in postings.lengths(d, "i", "t").collect()) == [(1, 3), (2, 0)]


def test_arrow_batches_are_small(spark):
    spark.conf.unset(LIMIT)
    x = corpus.extract(spark.createDataFrame([("<article>a</article>",)], "html string"), "html", body=("article",))
    assert spark.conf.get(LIMIT) == f"{4 << 20}b" and x.first().article.body == "a"
    spark.conf.set(LIMIT, "1m")  # a user's own bound stands
    corpus.extract(x.select("html"), "html")
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)


def test_changes_lie_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(catalogue_more, "FEED", 100_000)
    got = catalogue_more.incremental_terms(spark, "/root/testdata/sf0.001").count()
    feed = [p for p in tables._written[spark.sparkContext.applicationId] if "/feed-" in p][-1]
    assert len(spark.read.parquet(feed).inputFiles()) > 3 and got == catalogue.QUERIES["bm25_idf"](spark, "/root/testdata/sf0.001").count() - _only_in_deleted(spark)


def _only_in_deleted(spark):
    d = catalogue.table(spark, "/root/testdata/sf0.001", "documents")
    term = lambda x: postings.token_counts(x, "doc_id", "text").select("term").distinct()
    return term(d).subtract(term(d.where("doc_id % 10 <> 7"))).count()


def test_every_vector_is_collapsed_to_parents(spark):
    got = catalogue.dense_parent_collapse(spark, "/root/testdata/sf0.001").groupBy("query").count().collect()
    ids = catalogue.table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id").collect()
    assert sorted((r["query"], r["count"]) for r in got) == sorted((r.vec_id, 5) for r in ids)


def test_scores_of_parents_round_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    first = (1.0, 0.41766665, 0.401952950, 0.38387425, 0.41766675, -0.41007425, 0.25, 0.0)
    v = spark.createDataFrame([(i, [x, *[0.0] * 63]) for i, x in enumerate(first)], "vec_id long, embedding array<double>")
    v.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["query", "parent", "matched_child", "score", "rank"]
    want = c.sql(catalogue.ORACLES["dense_parent_collapse"]).project(", ".join(names)).fetchall()
    got = catalogue.dense_parent_collapse(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 16


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "large", "copies"])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_held_scores_give_the_best(kind, k):
    rng = np.random.default_rng(k)
    s = rng.normal(size=(70, 900))
    if kind == "ties":
        s = np.round(s, 1) + rng.choice([0, 3e-10, -3e-10], s.shape)
    elif kind == "odd":
        s[rng.random(s.shape) < 0.3] = np.nan
        s[rng.random(s.shape) < 0.01] = -np.inf
        s[3, 5], s[4] = np.inf, np.nan
    elif kind == "large":
        s = np.round(s * 4) * 1e8 + rng.choice([0, 1e-8], s.shape)
    elif kind == "copies":
        s = s[:, rng.integers(0, 7, 900)]
    items, best, held = rng.permutation(900), retrieval.Best(70, k), retrieval.Held(70, k)
    for lo in range(0, 900, 32):
        best.add(np.round(s[:, lo : lo + 32], retrieval.DP), items[lo : lo + 32])
        held.add(s[:, lo : lo + 32], items[lo : lo + 32])
    held._fold()
    r = np.where(np.isnan(s), -np.inf, np.round(s, retrieval.DP))
    o = np.lexsort((np.broadcast_to(items, r.shape), -r), axis=1)[:, :k]
    want = np.take_along_axis(r, o, 1)
    ok = np.isfinite(want)
    for x in (best, held):
        assert (x.score[ok] == want[ok]).all() and (x.item[ok] == items[o][ok]).all() and not np.isfinite(x.score[~ok]).any()


def test_blocks_of_queries_give_one_ranking(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i % 40, x.tolist()) for i, x in enumerate(rng.normal(size=(50, 4)))], "i long, v array<double>")
    rows = lambda: sorted(map(tuple, retrieval.dense(v, v, 7, "i", "i", "v").select("query", "item", "score", "rank").collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "BLOCK", 9)
    assert rows() == whole and len(whole) == 40 * 7
