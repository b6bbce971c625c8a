"""Whole pipelines: pages to articles to chunks to an index; questions to hits and answers; gold items to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import embed
from ..functions import text as T
from ..operators import answers, chunking, evaluation, retrieval
from ..sources import corpus
from . import models
from .config import Config


def articles(cfg: Config, results: DataFrame, raw: DataFrame, strict: bool = True, body=corpus.BODY) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected) from search results (link, public_timestamp, title) and raw pages (slug, html)."""
    c = cfg.corpus
    m = corpus.select_links(results, "link", "public_timestamp", c.link_prefix, c.published_after, c.published_before, c.max_articles, c.base_url, "title")
    return corpus.clean(m, raw, strict, body)


def chunks(cfg: Config, arts: DataFrame, embedder=None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, parents or None) of articles (slug, source_url, title, summary, body_text[, sections]), counted in the settings' tokens; semantic ones by the settings' embedder unless another is given."""
    c = cfg.chunk
    to, back = models.tokens(cfg)
    ways = {"tokens": to} | ({"joined": back} if back else {})
    rows = arts.withColumn("text", T.assembled("title", "summary", "body_text"))
    url = arts.select(F.col("slug").alias("id"), "source_url")
    chunking.strategy(c.strategy)
    if c.strategy == "fixed":
        return chunking.fixed(rows, "slug", "text", c.size_tokens, c.overlap_tokens, **ways, keep=("source_url",)).select("chunk_id", "source_url", "text"), None
    if c.strategy == "small_to_big":
        big, small = chunking.small_to_big(rows, "slug", "text", c.size_tokens, c.child_size_tokens, c.child_overlap_tokens, **ways, keep=("source_url",))
        return small.select("chunk_id", "source_url", "text", "parent_id"), big.select("parent_id", "source_url", "text")
    if c.strategy == "header_aware":
        out = chunking.header_aware(rows, "slug", "sections", c.size_tokens, c.overlap_tokens, c.header_min_section_tokens, **ways)
        return out.join(url, "id").select("chunk_id", "source_url", "text"), None
    s = chunking.sentence_rows(rows, "slug", "text")
    near = rows.select(F.col("slug").alias("id"), F.posexplode(chunking.buffered(T.sentences("text"))).alias("i", "buffered"))
    vec = s.join(near, ["id", "i"]).withColumn("v", (embedder or models.embedder(cfg))("buffered"))
    out = chunking.semantic(vec, "id", "i", "sentence", "v", c.size_tokens, c.overlap_tokens, c.semantic_breakpoint_percentile, **ways)
    out = out.withColumn("chunk_id", F.concat_ws("::", "id", F.col("part").cast("string"), F.col("piece").cast("string")))
    return out.join(url, "id").select("chunk_id", "source_url", "text"), None


@dataclass
class Index:
    """Chunks with a position and a unit vector, and parents where children were cut."""

    rows: DataFrame
    parents: DataFrame | None = None

    def write(self, path: str) -> int:
        """Write the index; the number of its chunks."""
        self.rows.write.mode("overwrite").parquet(f"{path}/chunks")
        if self.parents is not None:
            self.parents.write.mode("overwrite").parquet(f"{path}/parents")
        return self.rows.count()

    @staticmethod
    def read(spark, path: str) -> Index:
        """The index in a folder; raises FileNotFoundError where there is none."""
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.parquet(f"{path}/chunks")
        except AnalysisException as e:
            raise FileNotFoundError(f"no index in {path}; build it first") from e
        try:
            return Index(rows, spark.read.parquet(f"{path}/parents"))
        except AnalysisException:
            return Index(rows)


def index(chunk_rows: DataFrame, parents: DataFrame | None = None, embedder=embed.hashed) -> Index:
    """Chunks with positions from 0 in the order of their ids, and vectors, written once. Raises where there is no chunk."""
    rows = tables.numbered(chunk_rows, "chunk_id")
    done = tables.cut(rows.withColumn("embedding", embedder("text")), "index")
    tables.drop(rows)
    if done.isEmpty():
        raise ValueError("no chunks to index; chunk the articles first")
    return Index(done, parents)


def retrieve(cfg: Config, idx: Index, questions: DataFrame, k: int | None = None, embedder=None, scorer=None) -> DataFrame:
    """Ranked hits (query, rank, score, source_url, text, ...) for questions (query, question); embedder and scorer are those of the settings unless others are given."""
    r = cfg.retriever
    embedder = embedder or models.embedder(cfg)
    k = k or r.top_k
    n = r.rerank_top_n if r.reranker_enabled else k
    # vectors are searched by number; the questions' own ids come back at the end
    q = questions.select("query", "question", F.xxhash64("query").alias("no")).withColumn("embedding", embedder(F.concat(F.lit(cfg.embedding.query_prefix), F.col("question"))))
    as_query = q.select(F.col("no").alias("position"), "embedding")
    rows = idx.rows
    if r.type == "hybrid":
        pool = retrieval.pool_size(n)
        d = retrieval.dense(as_query, rows, pool, "position", "position", "embedding")
        lexical = retrieval.Lexical(rows, "position", "text")
        lx = lexical.top(q, "no", "question", pool)
        lexical.reset()
        hits = retrieval.fuse(d, lx, n, r.rrf_k)
    elif r.type != "dense":
        raise ValueError(f"unknown retriever {r.type!r}")
    elif idx.parents is not None:
        pool = retrieval.pool_size(n, 6)
        d = retrieval.dense(as_query, rows, pool, "position", "position", "embedding")
        d = d.join(rows.select(F.col("position").alias("item"), F.col("parent_id").alias("parent")), "item")
        d = tables.cut(d, "children")
        # the parents of hits are looked up once: their table may be cut from all texts anew
        found = tables.cut(idx.parents.withColumnRenamed("parent_id", "parent").join(d.select("parent").distinct(), "parent", "left_semi").select("parent", "source_url", "text"), "parents")
        best = retrieval.collapse(d, found.select("parent"), n, pool)
        hits = best.join(found.select("parent", "source_url", "text"), "parent").withColumnRenamed("parent", "chunk_id")
    else:
        hits = retrieval.dense(as_query, rows, n, "position", "position", "embedding")
    if "text" not in hits.columns:
        hits = hits.join(rows.select(F.col("position").alias("item"), "chunk_id", "source_url", "text"), "item")
    hits = hits.join(q.select(F.col("no"), F.col("query").alias("_q"), "question"), hits["query"] == F.col("no")).drop("query", "no").withColumnRenamed("_q", "query")
    if r.reranker_enabled:
        hits = retrieval.rerank(hits, (scorer or models.scorer(cfg))("question", "text"), k)
    return hits.where(F.col("rank") <= k)


def answer(cfg: Config, idx: Index, questions: DataFrame, metadata: DataFrame | None = None, model=None, hits: DataFrame | None = None, **kw) -> DataFrame:
    """(query, question, answer, sources) for every question, from ``hits`` if they are there already."""
    hits = retrieve(cfg, idx, questions, **kw) if hits is None else hits
    shown = answers.enrich(hits, metadata) if cfg.llm.metadata_enabled and metadata is not None else hits
    p = answers.prompts(questions, answers.context(shown, metadata=cfg.llm.metadata_enabled and metadata is not None))
    return answers.generate(p, model or models.generator(cfg), ("query", "question")).join(answers.sources(hits), "query", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def evaluate(cfg: Config, idx: Index, gold: DataFrame, k: int = 10, limit: int | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(metrics, per item) of retrieval over the answerable gold items (``limit``: the first of them)."""
    ask = corpus.answerable(gold if limit is None else evaluation.limited(gold, limit))
    q = ask.select(F.col("id").alias("query"), "question")
    hits = retrieve(cfg, idx, q, k, **kw)
    passages = ask.select("id", F.posexplode("supporting_passages").alias("n", "p")).select(F.concat_ws("#", "id", F.col("n").cast("string")).alias("pid"), F.col("id").alias("query"), F.col("p.passage_text").alias("passage"))
    texts = hits.select(F.col("chunk_id").alias("item"), "text").dropDuplicates(["item"])
    ok = evaluation.any_of(evaluation.containment(passages, texts, "pid", "passage", "item", "text", entities=True), passages, "query", "pid", "item")
    ranks = evaluation.first_relevant(hits.select("query", F.col("chunk_id").alias("item"), "rank"), ok, q)
    return evaluation.retrieval_metrics(ranks), ranks


def judged(cfg: Config, idx: Index, gold: DataFrame, metadata: DataFrame | None = None, model=None, judge=None, **kw) -> DataFrame:
    """(id, question, answer, sources, answerable, refused, label, faithful) for every gold item: answers, and their judge's verdicts."""
    q = gold.select(F.col("id").alias("query"), "question")
    judge = judge or models.judge(cfg)
    hits = tables.cut(retrieve(cfg, idx, q, **kw), "hits")
    got = answer(cfg, idx, q, metadata, model, hits).select(F.col("query").alias("id"), "answer", "sources")
    rows = gold.select("id", "question", "answer_key", "answerable").join(got, "id").join(answers.context(hits).withColumnRenamed("query", "id"), "id", "left")
    rows = rows.withColumn("faith", answers.faithfulness_prompt("answer", "context")).withColumn("right", answers.correctness_prompt("question", "answer_key", "answer"))
    keep = ("id", "question", "answer", "sources", "answerable", "right")
    rows = answers.generate(rows.withColumnRenamed("faith", "prompt").drop("answer").join(got.select("id", "answer"), "id"), judge, keep, "raw_faith")
    rows = answers.generate(rows.withColumnRenamed("right", "prompt"), judge, ("id", "question", "answer", "sources", "answerable", "raw_faith"), "raw_right")
    return rows.select("id", "question", "answer", "sources", "answerable", T.is_refusal("answer").alias("refused"), answers.correctness("raw_right").alias("label"), answers.faithful("raw_faith").alias("faithful"))


def result_row(metrics: DataFrame, per_item: DataFrame, cfg: Config, stamp: str, gold_set: str, tag: str = "retrieval") -> DataFrame:
    """One row of a run: stamp, tag, gold set, settings, metrics, and every item by id (a gold set's items stand in the one row)."""
    import dataclasses
    import json

    items = per_item.agg(F.array_sort(F.collect_list(F.struct(*sorted(per_item.columns, key=lambda c: (c not in ("id", "query"), c))))).alias("per_item"))
    row = metrics.select(F.struct(*metrics.columns).alias("metrics")).crossJoin(F.broadcast(items))
    return row.select(F.lit(stamp).alias("timestamp"), F.lit(tag).alias("tag"), F.lit(gold_set).alias("gold_set"), F.lit(json.dumps(dataclasses.asdict(cfg), sort_keys=True)).alias("config"), "metrics", "per_item")


def write_result(row: DataFrame, folder: str) -> str:
    """Write a run's row as JSON under its stamp and tag; the path."""
    r = row.select("timestamp", "tag").first()
    path = f"{folder}/{r.timestamp.replace(':', '')}_{r.tag}.json"
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
