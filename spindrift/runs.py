"""Runs that join operators up over a work folder: snapshot, certify, metadata probe, latency, pairs, train, demo cache, judge validation."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .functions import text as T
from .operators import answers, chunking, evaluation, fitting, retrieval, training
from .plans import models, pipeline
from .plans.config import Config
from .sources import corpus


def articles(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.parquet(f"{work}/articles")


def snapshot(spark: SparkSession, work: str) -> str:
    """Write the snapshot of the work folder's articles; its id."""
    corpus.write_snapshot(corpus.snapshot(articles(spark, work), "slug", "published_date"), f"{work}/snapshot")
    return corpus.load_snapshot(spark, f"{work}/snapshot").first().snapshot_id


def stamp(spark: SparkSession, work: str, version: str = "v1") -> str:
    """A gold set's version and the written snapshot that it is judged on, unknown where none is written."""
    try:
        snap = corpus.load_snapshot(spark, f"{work}/snapshot")
    except AnalysisException:
        snap = None
    return corpus.gold_stamp(version, snap)


def gold(spark: SparkSession, work: str, path: str) -> DataFrame:
    """Gold items whose passages' sources are articles of the work folder; anything else raises."""
    return corpus.load_gold(spark, path, articles(spark, work).select("source_url"))


def _passages(items: DataFrame) -> DataFrame:
    rows = corpus.answerable(items).select("id", F.posexplode("supporting_passages").alias("n", "p"))
    return rows.select(F.concat_ws("#", "id", F.col("n").cast("string")).alias("passage"), "id", F.col("p.source_url").alias("source_url"), F.col("p.passage_text").alias("text"))


def certify(spark: SparkSession, cfg: Config, work: str, gold_path: str) -> DataFrame:
    """(passage, id, status): whether a chunk or only an article holds each gold passage; written to the work folder."""
    p, arts = _passages(gold(spark, work, gold_path)), articles(spark, work)
    whole = arts.select("source_url", T.assembled("title", "summary", "body_text").alias("text"))
    in_chunk = evaluation.containment(p, spark.read.parquet(f"{work}/chunks"), "passage", "text", "chunk_id", "text", entities=True)
    in_article = evaluation.containment(p, whole, "passage", "text", "source_url", "text", entities=True)
    status = evaluation.passage_status(p, in_chunk, in_article, "passage").join(p.select("passage", "id"), "passage")
    status.write.mode("overwrite").parquet(f"{work}/certified")
    return spark.read.parquet(f"{work}/certified")


def metadata_probe(spark: SparkSession, cfg: Config, work: str, gold_path: str) -> DataFrame:
    """One row: gold items answered correctly without and with metadata in the prompt, and those that changed."""
    import dataclasses

    items, idx = gold(spark, work, gold_path), pipeline.Index.read(spark, f"{work}/index")
    meta = answers.article_metadata(articles(spark, work), "source_url", "slug", "published_date")
    got = []
    for on in (False, True):
        c = dataclasses.replace(cfg, llm=dataclasses.replace(cfg.llm, metadata_enabled=on))
        got.append(pipeline.judged(c, idx, corpus.answerable(items), meta).select("id", (F.col("label") == "correct").alias("ok")))
    return evaluation.probe_flips(*got, "id", "ok")


def latency(spark: SparkSession, cfg: Config, work: str, questions: list[str]) -> DataFrame:
    """(name, n, median_s, p95_s, min_s, max_s) of retrieval and generation, timed question by question, as a user waits for them."""
    idx, model, rows = pipeline.Index.read(spark, f"{work}/index"), models.generator(cfg), []
    for i, text in enumerate(questions):
        q = spark.createDataFrame([(str(i), text)], "query string, question string")
        began = time.perf_counter()
        hits = pipeline.retrieve(cfg, idx, q)
        found = answers.prompts(q, answers.context(hits)).collect()
        rows.append(("retrieval", time.perf_counter() - began))
        began = time.perf_counter()
        model([r.prompt for r in found])
        rows.append(("generation", time.perf_counter() - began))
    return evaluation.latency(spark.createDataFrame(rows, "name string, seconds double"), "name", "seconds")


def pairs(spark: SparkSession, cfg: Config, work: str, gold_path: str, target: int = 1000, each: int = 2, model=None, seed: int = 0) -> DataFrame:
    """Training pairs with their texts (query, item, question, text, label, part), written to the work folder.

    Chunks without a gold passage, in seeded order, are given to a question
    model until ``target`` questions are there; a chunk answers its questions,
    the best other chunk by BM25 is a hard negative. Parts are split by question.
    ``model`` goes from prompts to lines of questions; the settings' generator
    stands in.
    """
    idx = pipeline.Index.read(spark, f"{work}/index")
    known = _passages(gold(spark, work, gold_path))
    free = training.without_leaks(idx.rows.select("chunk_id", "position", "text"), known, "chunk_id", "text", "passage", "text")
    order = training.shuffled(free, "chunk_id", seed).withColumn("n", F.lit(each))
    asked = training.until_target(order, "place", "n", target).withColumn("prompt", F.concat(F.lit("Write questions that this text answers, one a line.\n\n"), "text"))
    raw = answers.generate(asked, model or models.generator(cfg), ("position", "place"), "raw")
    q = raw.select(F.col("position").alias("item"), "place", F.posexplode(training.questions("raw", each)).alias("i", "question"))
    q = tables.cut(q.select((F.col("place") * each + F.col("i")).cast("long").alias("query"), "item", "question"), "questions")
    positives, banned = q.select("query", "item"), idx.rows.select(F.col("position").alias("item"), "chunk_id").join(free.select("chunk_id"), "chunk_id", "left_anti").select("item")
    lexical = retrieval.Lexical(idx.rows, "position", "text")
    negatives = training.mined(lexical, q, positives, banned, "query", "question")
    both = training.pairs(positives, negatives).join(q.select("query", "question"), "query").join(idx.rows.select(F.col("position").alias("item"), "text"), "item")
    parts = training.split(q.select("query"), "query").select("query", "part")
    both.join(parts, "query").write.mode("overwrite").parquet(f"{work}/pairs")
    lexical.reset()
    return spark.read.parquet(f"{work}/pairs")


def train(spark: SparkSession, work: str, **kw) -> tuple[str, list]:
    """Fit the pair scorer on the work folder's pairs; (the name to set as reranker_model, reports)."""
    rows = spark.read.parquet(f"{work}/pairs")
    best, reports = fitting.fit(rows.where("part = 'train'"), rows.where("part = 'val'"), "question", "text", **kw)
    return "fitted:" + best.write(spark, f"{work}/scorer"), reports


def cache(spark: SparkSession, cfg: Config, work: str, questions: list[tuple[str, bool]]) -> str:
    """Answer (question, adversarial) ahead and write them with their passages as JSON for display; the path."""
    idx = pipeline.Index.read(spark, f"{work}/index")
    q = spark.createDataFrame([(str(i), t, a) for i, (t, a) in enumerate(questions)], "query string, question string, hard boolean")
    hits = tables.cut(pipeline.retrieve(cfg, idx, q), "hits")
    titles = articles(spark, work).select("source_url", "title", F.col("published_date").alias("date"))
    answered = pipeline.answer(cfg, idx, q.select("query", "question"), hits=hits)
    answers.write_demo(answers.demo_cache(answers.demo_rows(hits, titles), answered, q.where("hard")), f"{work}/demo", retriever=cfg.retriever.type, model=cfg.llm.model)
    return f"{work}/demo"


def validate_judge(spark: SparkSession, cfg: Config, work: str, gold_path: str, ids: list[str], now: str) -> str:
    """Markdown for grading the judge by hand, below whether it catches the negative controls."""
    idx = pipeline.Index.read(spark, f"{work}/index")
    caught = {r.case: r.caught for r in answers.probe_judge(spark, models.judge(cfg)).collect()}
    items = gold(spark, work, gold_path).where(F.col("id").isin(ids))
    rows = pipeline.judged(cfg, idx, items).join(items.select("id", "answer_key"), "id")
    sheet = answers.judge_sheet(rows, ids, cfg.llm.judge_model, cfg.llm.model, now)
    return sheet + "\n## Negative controls\n" + "".join(f"- {k}: {'caught' if v else 'MISSED'}\n" for k, v in sorted(caught.items()))


def header_stats(spark: SparkSession, cfg: Config, work: str) -> DataFrame:
    """Sections and chunks by subtype, as the header-aware strategy would cut the articles."""
    a = articles(spark, work).withColumn("subtype", T.subtype("slug"))
    c = cfg.chunk
    return chunking.section_stats(a, "slug", "subtype", "sections", c.size_tokens, c.overlap_tokens, c.header_min_section_tokens)[0]
