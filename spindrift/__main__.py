"""python -m spindrift [--config FILE] COMMAND: build, ingest, clean, chunk, index, snapshot, diff-check, ask, smoke-test, eval,
certify, probe, latency, pairs, train, cache, validate-judge, section-stats, serve, query, queries.

A work folder holds manifest, raw, articles, snapshot, chunks, parents and index, and what the runs write beside them.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from . import catalogue, runs
from .operators import training
from .plans import config, models, pipeline
from .sources import corpus

SMOKE = ("How should a faulty pump be reported?", "Which medicines do pregnant patients avoid?", "How long does bread need in the oven?")


def _get(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as f:
        return f.read().decode("utf-8", "replace")


def ingest(spark, cfg, work: str, results=None, get=_get, pause: float = 1.0) -> None:
    """Search results (from the API unless given) to the manifest, and the pages that aren't there yet."""
    c = cfg.corpus
    if results is None:
        results = corpus.search(spark, c.search_api, "drug_safety_update", c.published_after, c.published_before, c.max_articles)
    m = corpus.select_links(results, "link", "public_timestamp", c.link_prefix, c.published_after, c.published_before, c.max_articles, c.base_url, "title")
    corpus.write_lines(m.select("url", "slug", "title", "published_date"), f"{work}/manifest")
    manifest = corpus.read_lines(spark, f"{work}/manifest", "manifest")
    from pyspark.errors import AnalysisException

    try:
        cached = spark.read.parquet(f"{work}/raw").select("name")
    except AnalysisException:
        cached = spark.createDataFrame([], "name string")
    corpus.fetch_all(manifest, cached, get, pause=pause).write.mode("append").parquet(f"{work}/raw")


def clean(spark, work: str, strict: bool = True, body=corpus.BODY) -> None:
    manifest, raw = corpus.read_lines(spark, f"{work}/manifest", "manifest"), spark.read.parquet(f"{work}/raw").select("slug", "html").dropDuplicates(["slug"])
    corpus.require_pages(manifest, raw)
    corpus.clean(manifest, raw, strict, body)[0].write.mode("overwrite").parquet(f"{work}/articles")


def chunk(spark, cfg, work: str) -> None:
    rows, parents = pipeline.chunks(cfg, spark.read.parquet(f"{work}/articles"))
    rows.write.mode("overwrite").parquet(f"{work}/chunks")
    if parents is not None:
        parents.write.mode("overwrite").parquet(f"{work}/parents")


def index(spark, cfg, work: str) -> int:
    parents = spark.read.parquet(f"{work}/parents") if cfg.chunk.strategy == "small_to_big" else None
    return pipeline.index(spark.read.parquet(f"{work}/chunks"), parents, models.embedder(cfg)).write(f"{work}/index")


def build(spark, cfg, work: str, **kw) -> int:
    ingest(spark, cfg, work, **kw)
    clean(spark, work)
    runs.snapshot(spark, work)
    chunk(spark, cfg, work)
    return index(spark, cfg, work)


def ask(spark, cfg, work: str, questions) -> list:
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(questions)], "query string, question string")
    return pipeline.answer(cfg, pipeline.Index.read(spark, f"{work}/index"), q).orderBy("query").collect()


def evaluate(spark, cfg, work: str, gold_path: str, limit: int | None, retrieval_only: bool, stamp: str) -> str:
    """Metrics of a gold set, written as the run's row under its corpus' snapshot; its path. Passages from articles that aren't in the work folder raise."""
    from .operators import evaluation

    gold, idx = runs.gold(spark, work, gold_path), pipeline.Index.read(spark, f"{work}/index")
    metrics, ranks = pipeline.evaluate(cfg, idx, gold, limit=limit)
    tag = "retrieval" if retrieval_only else "full"
    if not retrieval_only:
        rows = pipeline.judged(cfg, idx, gold if limit is None else evaluation.limited(gold, limit))
        metrics = metrics.crossJoin(evaluation.answer_counts(rows))
        ranks = rows.drop("sources").withColumnRenamed("id", "query").join(ranks, "query", "left")
    return pipeline.write_result(pipeline.result_row(metrics, ranks, cfg, stamp, runs.stamp(spark, work), tag), f"{work}/results")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("build", "search results to an index"), ("ingest", "search results to pages"), ("clean", "pages to articles"), ("chunk", "articles to chunks"), ("index", "chunks to an index"), ("snapshot", "the id of the articles, written"), ("train", "pairs to a scorer"), ("section-stats", "sections by subtype"), ("diff-check", "whether the oldest and newest page agree in structure"), ("smoke-test", "answers to a few questions")):
        sub.add_parser(name, help=words).add_argument("work")
    c = sub.add_parser("ask", help="answer a question from an index")
    c.add_argument("work")
    c.add_argument("question")
    c = sub.add_parser("eval", help="metrics of a gold set")
    c.add_argument("work")
    c.add_argument("gold")
    c.add_argument("--limit", type=int)
    c.add_argument("--retrieval-only", action="store_true")
    for name, words in (("certify", "where the passages of a gold set are held"), ("probe", "answers without and with metadata"), ("pairs", "chunks to training pairs"), ("validate-judge", "a sheet for grading the judge")):
        c = sub.add_parser(name, help=words)
        c.add_argument("work")
        c.add_argument("gold")
        if name == "pairs":
            c.add_argument("--target", type=int, default=1000)
        if name == "validate-judge":
            c.add_argument("ids", nargs="+")
    for name, words in (("latency", "seconds a question"), ("cache", "answers for display")):
        c = sub.add_parser(name, help=words)
        c.add_argument("work")
        c.add_argument("questions", nargs="*", default=list(SMOKE))
    c = sub.add_parser("serve", help="answer over HTTP")
    c.add_argument("work")
    c.add_argument("--port", type=int, default=8000)
    c = sub.add_parser("query", help="run a named query over a folder of tables")
    c.add_argument("name")
    c.add_argument("tables")
    sub.add_parser("queries", help="list the named queries")
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(catalogue.QUERIES))
        return 0
    if a.command == "ask" and not 3 <= len(a.question) <= 500:
        p.error("a question has 3 to 500 characters")
    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    if a.command == "query":
        catalogue.QUERIES[a.name](spark, a.tables).show(50, truncate=False)
        return 0
    cfg = config.load(a.config) if a.config else config.Config()
    models.check(cfg)
    if a.command in ("ask", "smoke-test"):
        for r in ask(spark, cfg, a.work, [a.question] if a.command == "ask" else SMOKE):
            print(r.question, r.answer, *r.sources, sep="\n")
    elif a.command == "diff-check":
        pages = spark.read.parquet(f"{a.work}/raw").join(corpus.read_lines(spark, f"{a.work}/manifest", "manifest"), "slug")
        corpus.same_structure(pages, "published_date", "html").show(truncate=False)
    elif a.command == "snapshot":
        print(runs.snapshot(spark, a.work))
    elif a.command == "section-stats":
        runs.header_stats(spark, cfg, a.work).show(50, truncate=False)
    elif a.command == "certify":
        runs.certify(spark, cfg, a.work, a.gold).show(50, truncate=False)
    elif a.command == "probe":
        runs.metadata_probe(spark, cfg, a.work, a.gold).show()
    elif a.command == "latency":
        runs.latency(spark, cfg, a.work, a.questions).show()
    elif a.command == "pairs":
        training.pair_counts(runs.pairs(spark, cfg, a.work, a.gold, a.target)).show()
    elif a.command == "train":
        name, reports = runs.train(spark, a.work)
        print(name, *reports, sep="\n")
    elif a.command == "cache":
        print(runs.cache(spark, cfg, a.work, [(q, False) for q in a.questions]))
    elif a.command == "validate-judge":
        print(runs.validate_judge(spark, cfg, a.work, a.gold, a.ids, datetime.datetime.now().isoformat(timespec="minutes")))
    elif a.command == "eval":
        print(evaluate(spark, cfg, a.work, a.gold, a.limit, a.retrieval_only, datetime.datetime.now().isoformat(timespec="seconds")))
    elif a.command == "serve":
        from . import serve

        idx = pipeline.Index.read(spark, f"{a.work}/index")

        def one(question):
            r = pipeline.answer(cfg, idx, spark.createDataFrame([("q", question)], "query string, question string")).first()
            return {"answer": r.answer, "sources": r.sources}

        serve.server(serve.State(one), a.port).serve_forever()
    else:
        {"build": lambda: build(spark, cfg, a.work), "ingest": lambda: ingest(spark, cfg, a.work), "clean": lambda: clean(spark, a.work), "chunk": lambda: chunk(spark, cfg, a.work), "index": lambda: index(spark, cfg, a.work)}[a.command]()
    return 0


if __name__ == "__main__":
    sys.exit(main())
