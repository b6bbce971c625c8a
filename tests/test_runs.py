"""Settings that act or are refused, and the runs over a work folder."""

import json

import pytest

from spindrift import __main__ as cli
from spindrift import runs
from spindrift.operators import answers, chunking
from spindrift.plans import config, models, pipeline
from spindrift.sources import corpus

TEXTS = {
    "insulin-pump": "Insulin pumps may fail in the cold. Check the alarm of a pump each morning. Is the battery full before a long journey? What should patients do when the alarm sounds?",
    "paracetamol-dose": "The dose of paracetamol is limited. Ask a doctor about the dose for children. How often may the dose be given? Which other medicines hold paracetamol?",
    "warfarin-diet": "Warfarin and some food do not mix. Keep a steady diet with warfarin. Why does a change of diet matter? When should the blood be tested again?",
    "insulin-pen": "An insulin pen must not be shared. Change the needle of the pen each time. Where is the pen kept when it is hot? Who may use the pen of a patient?",
}
ITEM = '{{"id":"{}","question":"{}","answer_key":"{}","register":"either","type":"{}","phrasing":"verbatim","answerable":{},"supporting_passages":[{}]}}\n'
CFG = config.Config(chunk=config.Chunk(size_tokens=24, overlap_tokens=4), retriever=config.Retriever(type="hybrid", top_k=2))


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("work"))
    results = spark.createDataFrame([(f"http://x/{k}", f"2024-01-0{i + 1}", k.upper()) for i, k in enumerate(TEXTS)], "link string, public_timestamp string, title string")
    cli.ingest(spark, CFG, at, results, lambda url: f"<h1>{url[9:]}</h1><article><p>{TEXTS[url[9:]]}</p></article>", pause=0)
    cli.clean(spark, at, body=("article",))
    cli.chunk(spark, CFG, at)
    cli.index(spark, CFG, at)
    return at


@pytest.fixture(scope="module")
def gold(tmp_path_factory):
    f = tmp_path_factory.mktemp("gold") / "gold.jsonl"
    passage = '{{"source_url":"http://x/{}","passage_text":"{}"}}'
    f.write_text(
        ITEM.format("q1", "pump alarm", "pumps may fail", "single_passage", "true", passage.format("insulin-pump", "pumps may fail in the cold"))
        + ITEM.format("q2", "dose for children", "ask a doctor", "multi_passage", "true", passage.format("paracetamol-dose", "ask a doctor about the dose for children how often may the dose be given which other medicines hold") + "," + passage.format("warfarin-diet", "nothing of the kind at all"))
        + ITEM.format("q3", "moon", "", "unanswerable", "false", "")
    )
    return str(f)


def test_repeated_links_give_no_more_articles(spark):
    results = spark.createDataFrame([("/a", "2024-01-01", "First"), ("/a", "2024-01-02", "Second"), ("/b", "2024-01-03", "B")], "link string, public_timestamp string, title string")
    raw = spark.createDataFrame([("a", "<article><p>text a</p></article>"), ("a", "<article><p>text a2</p></article>"), ("b", "<article><p>text b</p></article>")], "slug string, html string")
    good, _ = pipeline.articles(config.Config(corpus=config.Corpus(base_url="http://x")), results, raw, body=("article",))
    assert sorted((r.source_url, r.title, r.body_text) for r in good.collect()) == [("http://x/a", "First", "text a2"), ("http://x/a", "Second", "text a2"), ("http://x/b", "B", "text b")]


def test_unknown_names_are_refused(spark):
    def with_(section, **kw):
        return config.sweep(config.Config(), section, **{k: [v] for k, v in kw.items()})[0]

    bad = [with_("embedding", model_name="m"), with_("llm", provider="p"), with_("llm", model="m"), with_("llm", judge_model="j"), with_("llm", temperature=0.5), with_("llm", max_tokens=0)]
    bad.append(config.Config(retriever=config.Retriever(reranker_enabled=True, reranker_model="r")))
    bad.append(config.Config(chunk=config.Chunk(strategy="header_aware", header_min_section_tokens=3, tokenizer="t")))
    for c in bad:
        with pytest.raises(ValueError, match="here|temperature|max_tokens|merged"):
            models.check(c)
    models.check(config.Config())
    with pytest.raises(ValueError, match="unknown kind"):
        models.register("other", "m", len)
    with pytest.raises(ValueError, match="unknown chunk strategy 'x'; known: fixed"):
        chunking.strategy("x")


def test_settings_choose_the_models(spark, work, monkeypatch):
    c = config.Config(embedding=config.Embedding(model_name="hashed-16"), llm=config.Llm(max_tokens=3), retriever=config.Retriever(top_k=1))
    idx = pipeline.index(spark.read.parquet(f"{work}/chunks"), None, models.embedder(c))
    assert len(idx.rows.first().embedding) == 16
    q = spark.createDataFrame([("q", "insulin pump alarm")], "query string, question string")
    assert len(pipeline.answer(c, idx, q).first().answer.split()) == 3
    monkeypatch.setitem(models._made["generator"], "p/m", lambda llm: lambda prompts: [f"{llm.temperature} {llm.max_tokens}"] * len(prompts))
    other = config.Config(embedding=c.embedding, retriever=c.retriever, llm=config.Llm(provider="p", model="m", temperature=0.7, max_tokens=9))
    assert pipeline.answer(other, idx, q).first().answer == "0.7 9"


def test_subword_chunks(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    text = "Pharmacovigilance reports arrive again and again, weekly."
    arts = spark.createDataFrame([("s", "u", "", "", text, [text])], "slug string, source_url string, title string, summary string, body_text string, sections array<string>")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = tok.encode(text, add_special_tokens=False).ids
    for kind in ("fixed", "header_aware", "small_to_big", "semantic"):
        c = config.Config(chunk=config.Chunk(strategy=kind, size_tokens=4, overlap_tokens=0, child_size_tokens=4, child_overlap_tokens=0, tokenizer=path))
        got = [r.text for r in pipeline.chunks(c, arts)[0].orderBy("chunk_id").collect()]
        assert got[0] == tok.decode(ids[:4], skip_special_tokens=True).strip() and len(got) == -(-len(ids) // 4)


def test_snapshot_gold_and_eval(spark, work, gold, tmp_path):
    assert runs.stamp(spark, work) == "v1+corpus:unknown"
    name = runs.snapshot(spark, work)
    assert len(name) == 12 and runs.stamp(spark, work, "v2") == f"v2+corpus:{name}"
    path = cli.evaluate(spark, CFG, work, gold, None, True, "2024-01-01T00:00:00")
    row = spark.read.json(path).first()
    assert row.gold_set == f"v1+corpus:{name}" and row.metrics.n == 2 and row.metrics.recall_at_1 >= 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text(ITEM.format("q1", "pump", "k", "single_passage", "true", '{"source_url":"http://x/elsewhere","passage_text":"t"}'))
    with pytest.raises(ValueError, match="q1: unknown source"):
        cli.evaluate(spark, CFG, work, str(bad), None, True, "now")


def test_certify_probe_latency(spark, work, gold):
    got = {r.passage: r.status for r in runs.certify(spark, CFG, work, gold).collect()}
    assert got == {"q1#0": "OK", "q2#0": "SPLIT", "q2#1": "MISSING"}
    r = runs.metadata_probe(spark, CFG, work, gold).first()
    assert r.passed_on - r.passed_off == r.delta == r.fixed - r.broken
    got = {r.name: r for r in runs.latency(spark, CFG, work, ["pump alarm", "dose"]).collect()}
    assert set(got) == {"retrieval", "generation"} and got["retrieval"].n == 2 and got["retrieval"].median_s > 0


def test_pairs_train_and_rerank(spark, work, gold):
    rows = runs.pairs(spark, CFG, work, gold, target=8, model=lambda prompts: ["\n".join(x.strip() + "?" for x in p.split("\n\n", 1)[1].split("?")) for p in prompts])
    got = rows.collect()
    assert got and {r.label for r in got} == {0, 1} and {r.part for r in got} == {"train", "val"}
    assert not any("pumps may fail in the cold" in r.text for r in got)  # a gold passage's chunk is never used
    name, reports = runs.train(spark, work, steps=4, every=2)
    assert name.startswith("fitted:") and [r[0] for r in reports] == [0, 2, 4]
    c = config.Config(chunk=CFG.chunk, retriever=config.Retriever(type="hybrid", top_k=1, reranker_enabled=True, reranker_model=name, rerank_top_n=4))
    q = spark.createDataFrame([("q", "Where is the pen kept when it is hot?")], "query string, question string")
    hit = pipeline.retrieve(c, pipeline.Index.read(spark, f"{work}/index"), q).first()
    assert 0 <= hit.rerank_score <= 1


def test_cache_and_judge_sheet(spark, work, gold):
    at = runs.cache(spark, CFG, work, [("pump alarm", False), ("moon?", True)])
    got = {r.question: r for r in spark.read.json(at).collect()}
    assert got["moon?"].adversarial and len(got["pump alarm"].chunks) == 2 and got["pump alarm"].config.model == "extractive"
    sheet = runs.validate_judge(spark, CFG, work, gold, ["q2", "q1"], "now")
    assert sheet.count("caught") == len(answers.CONTROLS) and sheet.index("## q2") < sheet.index("## q1")
    assert json.dumps(sheet)
    by = {r.subtype: r for r in runs.header_stats(spark, CFG, work).collect()}
    assert by["standalone"].n_articles == 4


def test_manifest_keeps_its_own_titles(spark):
    r = spark.createDataFrame([("/a", "2024-01-01", " One "), ("/a", "2024-01-02", "Two")], "link string, stamp string, title string")
    assert [tuple(x) for x in corpus.select_links(r, "link", "stamp", "/", "2024-01-01", "2024-12-31", 5, "http://x", "title").collect()] == [("http://x/a", "a", "One", "2024-01-01"), ("http://x/a", "a", "Two", "2024-01-02")]
