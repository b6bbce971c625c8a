"""Operators against small cases whose results follow from their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import embed
from spindrift.functions import text as T
from spindrift.operators import answers, chunking, evaluation, retrieval, training
from spindrift.plans import config, pipeline
from spindrift.sources import corpus


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first().x


def test_windows_agree_with_a_loop(spark):
    cases = [(n, size, over) for n in (0, 1, 7, 8, 9, 12, 30) for size, over in ((8, 2), (8, 9), (1, 0), (5, 4))]
    rows = spark.createDataFrame([(i, list(map(str, range(n)))) for i, (n, _, _) in enumerate(cases)], "i int, t array<string>")
    for i, (n, size, over) in enumerate(cases):
        want, at = [], 0
        while n:
            want.append([str(x) for x in range(at, min(n, at + size))])
            if at + size >= n:
                break
            at += max(1, size - over)
        assert rows.where(F.col("i") == i).select(chunking.windows(F.col("t"), size, over).alias("w")).first().w == want


def test_normalize(spark):
    assert one(spark, T.normalize("t"), t="Heart-Rate, 2 mg/day!") == "heart rate 2 mg day"
    assert one(spark, T.normalize("t", entities=True), t="a&nbsp;&amp; b") == "a b"
    x = one(spark, T.normalize(T.normalize("t")), t="Él  niño\t--x")
    assert x == one(spark, T.normalize("t"), t="Él  niño\t--x") == "él niño x"


def test_tokens_and_register(spark):
    assert one(spark, T.lexical_tokens("t"), t="Naïve COVID-19") == ["na", "ve", "covid", "19"]
    assert one(spark, T.register("t"), t="Advice for healthcare professionals. Advice for patients") == "HCP+patient"
    assert one(spark, T.register("t"), t="none") == "general"
    assert one(spark, T.is_refusal("t"), t=T.REFUSAL) and not one(spark, T.is_refusal("t"), t="an answer")
    name = one(spark, T.raw_name("t"), t="x" * 100)
    assert name.startswith("x" * 80 + "-") and name.endswith(".html") and len(name) == 80 + 1 + 8 + 5


def test_sentences(spark):
    assert one(spark, T.sentences("t"), t="One. Two? three\nFour.  ") == ["One.", "Two? three", "Four."]
    assert one(spark, chunking.buffered(T.sentences("t")), t="A. B. C.") == ["A. B.", "A. B. C.", "B. C."]


def test_merge_small(spark):
    words = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([([words(10), words(100), words(20), words(70)],), ([words(10), words(20)],), ([],)], "s array<string>")
    got = [[len(x.split()) for x in r.m] for r in df.select(chunking.merge_small(F.col("s"), 64).alias("m")).collect()]
    assert got == [[130, 70], [30], []]


def test_semantic_cut_is_strict(spark):
    # equal gaps: none is above the percentile
    v = spark.createDataFrame([(1, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(5)], "g int, i int, v array<double>")
    assert {r.part for r in chunking.semantic_groups(v, "g", "i", "v").collect()} == {0}


def test_fusion_ties(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, item int, rank int")
    lx = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query int, item int, rank int")
    assert [r.item for r in retrieval.fuse(d, lx, 3).orderBy("rank").collect()] == [10, 12, 11]
    a, b = d.where("item = 11").withColumn("rank", F.lit(1)), lx.where("item = 12")
    assert [r.item for r in retrieval.fuse(a, b, 3).orderBy("rank").collect()] == [11, 12]


def test_fusion_agrees_with_dict(spark):
    rng = random.Random(3)
    d = {q: rng.sample(range(12), 8) for q in range(20)}
    lx = {q: rng.sample(range(12), 8) for q in range(20)}
    frame = lambda x: spark.createDataFrame([(q, i, r + 1) for q, ids in x.items() for r, i in enumerate(ids)], "query int, item int, rank int")
    got = {}
    for r in retrieval.fuse(frame(d), frame(lx), 12).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.item)
    for q in d:
        score = {}
        for ids in (d[q], lx[q]):
            for r, i in enumerate(ids):
                score[i] = score.get(i, 0) + 1 / (61 + r)
        assert got[q] == sorted(score, key=lambda i: -score[i])


def test_collapse(spark):
    h = spark.createDataFrame([(1, 1, "p1", 0.9, 1), (1, 2, "p1", 0.8, 2), (1, 3, "gone", 0.75, 3), (1, 4, "p2", 0.7, 4)], "query int, item int, parent string, score double, rank int")
    p = spark.createDataFrame([("p1",), ("p2",)], "parent string")
    assert [(r.parent, r.rank) for r in retrieval.collapse(h, p, 2).orderBy("rank").collect()] == [("p1", 1), ("p2", 2)]


def test_bm25_agrees_with_a_loop(spark):
    import math

    docs = ["a b b c", "b c d", "b e f g h", "b", ""]
    queries = ["a b", "z", "c c d"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    qs = spark.createDataFrame(list(enumerate(queries)), "i int, t string")
    got = {}
    for r in retrieval.Lexical(df, "i", "t").top(qs, "i", "t", 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.item, r.score))
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    vocab = sorted({t for d in toks for t in d})
    df_ = {t: sum(t in d for d in toks) for t in vocab}
    raw = {t: math.log(n - df_[t] + 0.5) - math.log(df_[t] + 0.5) for t in vocab}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    for q, text in enumerate(queries):
        s = [round(sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in text.split()), 9) for d in toks]
        want = sorted(range(n), key=lambda i: (-s[i], i))
        assert [i for i, _ in got[q]] == want, (q, got[q], s)


def test_containment(spark):
    p = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "..."), (3, "lo wor"), (4, "q r s t u v w x y z")], "p int, t string")
    d = spark.createDataFrame([(1, "j i h g f e d c b z"), (2, "j i h g f e d c z z"), (3, "hello world"), (4, "x q r s t u v w y z, k")], "d int, t string")
    got = {(r.p, r.d) for r in evaluation.containment(p, d, "p", "t", "d", "t").collect()}
    assert got == {(1, 1), (3, 3), (4, 4)}


def test_metrics(spark):
    r = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 2)], "query int, first_relevant_rank int")
    m = evaluation.retrieval_metrics(r).first()
    assert (m.n, m.recall_at_1, m.recall_at_3, m.mrr) == (4, 1, 3, 0.4583)
    assert evaluation.retrieval_metrics(r.limit(0)).first().mrr == 0
    for n, want in ((20, 19), (31, 29)):
        lat = spark.createDataFrame([("a", float(i)) for i in range(1, n + 1)], "k string, v double")
        assert evaluation.latency(lat, "k", "v").first().p95_s == want
    c = spark.range(1).select(evaluation.count_ratio(F.lit(45), F.lit(64)).alias("c")).first().c
    assert (c.pct, c.label) == (70.3, "45/64 (70%)")


def test_verdicts(spark):
    df = spark.createDataFrame([('{"faithful": "true"}',), ("none",), ('so {"faithful": true, "label": "maybe"} there',)], "raw string")
    got = df.select(answers.faithful("raw").alias("f"), answers.correctness("raw").alias("l")).collect()
    assert [r.f for r in got] == [False, False, True] and {r.l for r in got} == {"wrong"}


def test_split_and_target(spark):
    rows = spark.range(95).withColumnRenamed("id", "k")
    n = {r.part: r["count"] for r in training.split(rows, "k").groupBy("part").count().collect()}
    assert n == {"val": 9, "train": 86}
    t = training.until_target(training.shuffled(rows, "k").withColumn("c", F.lit(2)), "place", "c", 3)
    assert t.agg(F.sum("c")).first()[0] == 4


PAGE = """<html><body><div>menu<br></div><h1> Title </h1><p class="x gem-c-lead-paragraph">Lead &amp; more.</p>
<div data-module="govspeak"><div class="wrap"><p>Intro</p><h2>First</h2><p>one<h3>sub</h3>two</p><h2>Second</h2><ul><li>three</li></ul></div></div><footer>end</footer></body>"""


def test_page(spark):
    p = corpus.parse_page(PAGE)
    assert (p["title"], p["summary"]) == ("Title", "Lead & more.")
    assert p["body"].split("\n") == ["Intro", "First", "one", "sub", "two", "Second", "three"]
    assert [s.split("\n")[-1] for s in p["sections"]] == ["Intro", "two", "three"] and p["sections"][0].startswith("Title\nLead")
    assert corpus.parse_page(None)["body"] is None and corpus.parse_page("<p>x</p>")["body"] is None


def test_clean(spark):
    m = spark.createDataFrame([("u/a", "a", "Given", "2024-01-01"), ("u/b", "b", "B", "2024-01-02"), ("u/c", "c", "C", "2024-01-03")], "url string, slug string, title string, published_date string")
    raw = spark.createDataFrame([("a", PAGE.replace("<h1> Title </h1>", "")), ("b", "<p>no body</p>"), ("c", PAGE.replace("Intro", "Related content"))], "slug string, html string")
    good, bad = corpus.clean(m, raw, strict=False)
    assert [(r.slug, r.title) for r in good.collect()] == [("a", "Given")]
    assert {(r.slug, r.problem) for r in bad.collect()} == {("b", "no body container"), ("c", "boilerplate")}
    with pytest.raises(Exception, match="boilerplate|no body container"):
        corpus.clean(m, raw)[0].collect()


def test_gold(spark, tmp_path):
    f = tmp_path / "gold.jsonl"
    f.write_text('{"id":"1","question":"q","answer_key":"a","register":"HCP","type":"single_passage","phrasing":"verbatim","answerable":true,"supporting_passages":[{"source_url":"u","passage_text":"p"}]}\n\n')
    known = spark.createDataFrame([("u",)], "source_url string")
    assert corpus.load_gold(spark, str(f), known).count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        corpus.load_gold(spark, str(f), known.limit(0))


@pytest.mark.parametrize("kind", ["fixed", "small_to_big", "header_aware", "semantic"])
@pytest.mark.parametrize("way", ["dense", "hybrid"])
def test_pipeline(spark, kind, way):
    texts = ["The cat sat on the mat. It slept all day.", "Insulin pumps may fail. Check the alarm.", "Paracetamol dose is limited. Ask a doctor."]
    arts = spark.createDataFrame([(f"s{i}", f"u{i}", f"T{i}", "", t, [t]) for i, t in enumerate(texts)], "slug string, source_url string, title string, summary string, body_text string, sections array<string>")
    cfg = config.Config(chunk=config.Chunk(strategy=kind, size_tokens=16, overlap_tokens=4, child_size_tokens=8, child_overlap_tokens=2), retriever=config.Retriever(type=way, top_k=2, reranker_enabled=way == "hybrid"))
    rows, parents = pipeline.chunks(cfg, arts)
    idx = pipeline.index(rows, parents)
    q = spark.createDataFrame([("q1", "insulin pump alarm"), ("q2", "paracetamol dose")], "query string, question string")
    got = {r["query"]: r for r in pipeline.answer(cfg, idx, q).collect()}
    assert "u1" in got["q1"].sources and "u2" in got["q2"].sources
    gold = spark.createDataFrame([("q1", "insulin pump alarm", True, [("u1", "pumps may fail")])], "id string, question string, answerable boolean, supporting_passages array<struct<source_url:string,passage_text:string>>")
    assert pipeline.evaluate(cfg, idx, gold)[0].first().recall_at_3 == 1


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("chunk:\n  size_tokens: 9\n")
    assert config.load(str(f)).chunk.size_tokens == 9
    f.write_text("chunk:\n  sise: 9\n")
    with pytest.raises(TypeError):
        config.load(str(f))
    assert [c.chunk.size_tokens for c in config.sweep(config.Config(), "chunk", size_tokens=[1, 2])] == [1, 2]
    with pytest.raises(ValueError, match="unknown chunk strategy"):
        chunking.strategy("other")


def test_embedder(spark):
    v = one(spark, embed.hashed("t"), t="some words here")
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and one(spark, embed.hashed("t"), t="") == [0.0] * embed.DIMS


def test_stream(spark, tmp_path):
    from spindrift.streaming import ingest

    spark.createDataFrame([(1, "a b c d"), (2, "e")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.append_chunks(src, str(tmp_path / "out"), str(tmp_path / "cp"), size=2, overlap=0).awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1::0", "1::1", "2::0"]


def test_hard_negatives_beyond_many_banned_copies(spark, tmp_path):
    """A question whose 50 best hits are all banned still gets its negative, with its rank among all."""
    from spindrift import catalogue

    passage = "the red fox jumped over nine lazy dogs near the river"
    docs = [(i, passage, "en", "s", len(passage)) for i in range(70)] + [(100, "a red fox slept", "en", "s", 15), (101, "nothing alike", "en", "s", 13)]
    docs += [(200 + i, f"filler{i} other{i}", "en", "s", 9) for i in range(300)]  # so that the passage's words are rare and its copies rank first
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r)[1:] for r in catalogue.hard_negatives(spark, str(tmp_path)).select("query", "item", "rank").collect()]
    assert len(got) == 1 and got[0][0] in (100, 101) and got[0][1] > 50


def test_fused_hits_agree_in_two_branches(spark):
    """Prompts and sources read the same hits, also where Spark reuses an exchange."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = spark.createDataFrame([(f"c{i:03d}", f"u{i}", " ".join(rng.choice(words) for _ in range(12))) for i in range(200)], "chunk_id string, source_url string, text string")
    idx = pipeline.index(rows)
    q = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(5))) for i in range(12)], "query long, question string")
    cfg = config.Config(retriever=config.Retriever(type="hybrid"))
    alone = {}
    for r in pipeline.retrieve(cfg, idx, q, 2).collect():
        alone.setdefault(r["query"], set()).add(r.source_url)
    got = {r["query"]: set(r.sources) for r in pipeline.answer(cfg, idx, q, k=2).collect()}
    assert got == alone and all(len(v) <= 2 for v in got.values())


def test_index_keeps_every_row(spark):
    """Positions 0..n-1 by chunk id, over several partitions that adaptive execution joins."""
    rows = spark.range(0, 6000, 1, 16).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("u").alias("source_url"), F.concat(F.repeat(F.lit("word "), 300), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        got = pipeline.index(rows).rows.select("position", "chunk_id").orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert [r.position for r in got] == list(range(6000)) and [r.chunk_id for r in got] == sorted(f"c{i}" for i in range(6000))
    with pytest.raises(ValueError, match="no chunks"):
        pipeline.index(rows.limit(0))
    with pytest.raises(FileNotFoundError):
        pipeline.Index.read(spark, "/nowhere/at/all")


def test_bm25_ranks_negative_scores_last(spark):
    """Where the mean idf is negative, an item without the term stands before those that hold it."""
    df = spark.createDataFrame([(0, "common"), (1, "common"), (2, "common"), (3, "")], "i int, t string")
    lexical = retrieval.Lexical(df, "i", "t")
    got = [(r.item, r.score) for r in lexical.top(spark.createDataFrame([(0, "common")], "i int, t string"), "i", "t", 4).orderBy("rank").collect()]
    assert [i for i, _ in got] == [3, 0, 1, 2] and got[0][1] == 0 > got[1][1]
    lexical.reset()
    assert lexical._counts is None and lexical.size == (4, 0.75)


def test_short_passages_meet_inner_words(spark):
    p = spark.createDataFrame([(1, "or"), (2, "lo wor"), (3, "wor lo"), (4, "x"), (5, "hello")], "p int, t string")
    d = spark.createDataFrame([(1, "hello world"), (2, "or else"), (3, "lo, wor"), (4, None)], "d int, t string")
    got = {(r.p, r.d) for r in evaluation.containment(p, d, "p", "t", "d", "t").collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 3), (5, 1)}


def test_best_keeps_the_first_of_ties():
    import numpy as np

    rng = np.random.default_rng(0)
    s, items = rng.integers(0, 4, (5, 60)).astype(float), rng.permutation(60)
    best = retrieval.Best(5, 7)
    for a in range(0, 60, 13):
        best.add(s[:, a : a + 13], items[a : a + 13])
    for q in range(5):
        o = sorted(range(60), key=lambda j: (-s[q, j], items[j]))[:7]
        assert best.item[q].tolist() == items[o].tolist() and best.score[q].tolist() == s[q, o].tolist()


def test_subwords(spark):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    text = "The Pharmacovigilance team's 12 reports, again and again and again."
    sub = T.Subwords(path)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    got = {(r.id, r.chunk_no): r.text for r in chunking.fixed(df, "i", "t", 6, 2, sub.tokens, sub.joined).collect()}
    ids, want, at = tok.encode(text, add_special_tokens=False).ids, {}, 0
    while True:
        want[1, len(want)] = tok.decode(ids[at : at + 6], skip_special_tokens=True).strip()
        if at + 6 >= len(ids):
            break
        at += 4
    assert got == want


def test_reference_settings_load(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("corpus:\n  search_api: http://x/s.json\n  base_url: http://x\n  published_after: '2022-01-01'\n  published_before: '2026-07-01'\n  max_articles: 200\nchunk:\n  strategy: fixed\n  size_tokens: 512\n  overlap_tokens: 50\nembedding:\n  model_name: m\n  query_prefix: 'find: '\nretriever:\n  type: hybrid\n  top_k: 5\n  rrf_k: 60\n  reranker_enabled: false\n  reranker_model: r\n  rerank_top_n: 50\nllm:\n  provider: p\n  model: m\n  temperature: 0.0\n  max_tokens: 800\n  judge_model: j\n")
    c = config.load(str(f))
    assert c.llm.judge_model == "j" and not c.llm.metadata_enabled and c.retriever.reranker_model == "r"


def test_missing_pages(spark):
    m = spark.createDataFrame([("u/a", "a", "A", "2024-01-01"), ("u/b", "b", "B", "2024-01-02")], "url string, slug string, title string, published_date string")
    raw = spark.createDataFrame([("a", PAGE)], "slug string, html string")
    good, bad = corpus.clean(m, raw, strict=False)
    assert [r.slug for r in good.collect()] == ["a"] and [(r.slug, r.problem) for r in bad.collect()] == [("b", "no page")]
    with pytest.raises(FileNotFoundError, match="b"):
        corpus.require_pages(m, raw)
    corpus.require_pages(m.where("slug = 'a'"), raw)


def test_search_and_fetch(spark):
    asked = []

    def get(url):
        asked.append(url)
        return {"results": [{"link": "/drug/a", "public_timestamp": "2024-02-03T04:05", "title": " A "}, {"link": "/other/b", "public_timestamp": "2024-02-04T04:05"}]}

    r = corpus.search(spark, "http://x/s.json", "kind", "2024-01-01", "2024-12-31", 7, get)
    m = corpus.select_links(r, "link", "public_timestamp", "/drug/", "2024-01-01", "2024-12-31", 7, "http://x")
    assert [tuple(x) for x in m.collect()] == [("http://x/drug/a", "a", "2024-02-03")]
    assert "count=7" in asked[0] and "from%3A2024-01-01%2Cto%3A2024-12-31" in asked[0]
    pages = corpus.fetch_all(m, spark.createDataFrame([], "name string"), lambda url: f"<p>{url}</p>", pause=0)
    got = pages.collect()
    assert [(x.slug, x.html) for x in got] == [("a", "<p>http://x/drug/a</p>")]
    assert corpus.fetch_all(m, pages.select("name"), len, pause=0).count() == 0
    assert corpus.to_fetch(m, pages.select("name"), force=True).count() == 1


def test_judge_sheet_and_controls(spark):
    assert all(r.caught for r in answers.probe_judge(spark, answers.overlap_judge).collect())
    assert not any(r.caught for r in answers.probe_judge(spark, lambda p: ['{"faithful": true, "label": "correct"}'] * len(p)).collect())
    rows = spark.createDataFrame([("q1", "Q?", "key", "ans", ["http://x/a"], True, False, "wrong", False), ("q2", "R?", None, "no", [], False, True, "wrong", False)], "id string, question string, answer_key string, answer string, sources array<string>, answerable boolean, refused boolean, label string, faithful boolean")
    text = answers.judge_sheet(rows, ["q2", "q1"], "j", "m", "now")
    assert text.index("## q2 (UNANSWERABLE)") < text.index("## q1 (answerable)") and "**Judge:** wrong, faithful False" in text


def test_judged_run_and_command_line(spark, tmp_path):
    from spindrift import __main__ as cli

    html = "<h1>{}</h1><article><p>{}</p></article>"
    texts = {"a": "Insulin pumps may fail. Check the alarm.", "b": "Paracetamol dose is limited. Ask a doctor."}
    results = spark.createDataFrame([(f"http://x/{k}", "2024-01-0%d" % (i + 1), k.upper()) for i, k in enumerate(texts)], "link string, public_timestamp string, title string")
    cfg = config.Config(chunk=config.Chunk(size_tokens=16, overlap_tokens=4), retriever=config.Retriever(type="hybrid", top_k=1))
    work = str(tmp_path / "work")
    cli.ingest(spark, cfg, work, results, lambda url: html.format(url, texts[url[-1]]), pause=0)
    cli.clean(spark, work, body=("article",))
    cli.chunk(spark, cfg, work)
    assert cli.index(spark, cfg, work) == 2
    assert "pumps" in cli.ask(spark, cfg, work, ["insulin pump alarm"])[0].answer
    gold = tmp_path / "gold.jsonl"
    item = '{{"id":"{}","question":"{}","answer_key":"{}","register":"either","type":"{}","phrasing":"verbatim","answerable":{},"supporting_passages":[{}]}}\n'
    gold.write_text(item.format("q1", "insulin pump alarm", "pumps may fail", "single_passage", "true", '{"source_url":"http://x/a","passage_text":"pumps may fail"}') + item.format("q2", "moon", "", "unanswerable", "false", ""))
    path = cli.evaluate(spark, cfg, work, str(gold), 1, False, "2024-01-01T00:00:00")
    row = spark.read.json(path).first()
    assert path.endswith("2024-01-01T000000_full.json") and row.metrics.recall_at_1 == 1 and row.metrics.correct == 1 and row.metrics.unanswerable == 1
    assert len(row.per_item) == 2


def test_server():
    from spindrift import serve

    state = serve.State()
    assert serve.respond(state, "GET", "/")[0] == 200 and serve.respond(state, "GET", "/health")[1]["retriever_ready"] is False
    ask = lambda q: serve.respond(state, "POST", "/ask", q)
    assert ask(b'{"question": "what?"}')[0] == 503 and ask(b'{"question": "a"}')[0] == ask(b"[]")[0] == ask(b"x")[0] == 422
    state.ask = lambda q: {"answer": q.upper(), "sources": ["u"]}
    assert ask(b'{"question": "what?"}') == (200, {"question": "what?", "answer": "WHAT?", "sources": ["u"], "disclaimer": serve.DISCLAIMER})
    assert serve.respond(state, "GET", "/other")[0] == 404


def test_pair_scorer(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(20)]
        rows.append((" ".join(t[3:9] if i % 2 else [rng.choice(words) for _ in range(6)]), " ".join(t), i % 2))
    df = spark.createDataFrame(rows, "q string, t string, label int")
    model, report = training.fit_scorer(df.limit(90), df.subtract(df.limit(90)), "q", "t")
    assert report["val_after"] >= 0.95 and abs(report["gap"]) <= 0.05 and model.coefficients.size == 4


def test_model_loads_once_a_name():
    seen = []
    a = embed.model("one", lambda n: seen.append(n) or object())
    assert embed.model("one", lambda n: 1 / 0) is a and embed.model("two", len) == 3 and seen == ["one"]


def test_sweep(spark):
    from spindrift import tables

    t = tables.cut(spark.range(3), "t")
    assert t.count() == 3 and tables.sweep(spark) >= 1 and tables.sweep(spark) == 0


def test_places_and_ranks_among_some(spark, monkeypatch):
    """Ranks of given items by counting, over several blocks of queries, and the best of allowed items."""
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(80)], "i long, t string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(7)], "q long, t string")
    lexical = retrieval.Lexical(docs, "i", "t")
    whole = lexical.top(asked, "q", "t", 100).collect()
    pick = spark.createDataFrame([(r.query, r.item, r.score) for r in whole if r["rank"] == 5 * r.query + 1], "query long, item long, score double")
    assert sorted((r.query, r["rank"]) for r in lexical.places(asked, "q", "t", pick).collect()) == [(q, 5 * q + 1) for q in range(7)]
    some = lexical.top(asked, "q", "t", 2, among=docs.where("i % 7 = 3").select(F.col("i").alias("item"))).collect()
    for q in range(7):
        assert [r.item for r in sorted(some, key=lambda r: r["rank"]) if r.query == q] == [r.item for r in sorted(whole, key=lambda r: r["rank"]) if r.query == q and r.item % 7 == 3][:2]
    lexical.reset()


def test_no_question_left(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    none = spark.createDataFrame([], "q long, text string")
    assert retrieval.Lexical(docs, "id", "text").top(none, "q", "text", 3).count() == 0
    idx = pipeline.index(spark.createDataFrame([("1::0", "u", "a b")], "chunk_id string, source_url string, text string"))
    asked = spark.createDataFrame([], "query long, question string")
    assert pipeline.retrieve(config.Config(retriever=config.Retriever(type="hybrid")), idx, asked, 3).count() == 0


def test_patient_passage_strips_every_space(spark):
    body = "\u00a0Advice for patients\n\u2003\n\u00a0one\u3000\ntwo\t\n \u00a0 \nthree\nfour"
    ends = "advice for PAT\u0130ENTS:\nkept\n\u00a0Report side effects\nlost"
    rows = spark.createDataFrame([(1, body), (2, ends)], "k int, body string")
    assert {r.k: r.passage for r in evaluation.patient_passage(rows, "k", "body").collect()} == {1: "one two\t three", 2: "kept"}
