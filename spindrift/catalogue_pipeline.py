"""Queries through whole pipelines, sources and sinks; ``catalogue`` adds them to its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables
from .catalogue import ART, GOLD, MATCH, NORM, RANKS, REG, SPC, SUB, TOK, URL, _articles, _gold, _hits, _matches, _n_windows, _pairs, _ranks, _url, bm25_sql, query, table
from .functions import embed
from .functions import text as T
from .operators import answers, chunking, evaluation, training
from .plans import config, pipeline
from .sources import corpus
from .streaming import ingest

# --- retrieval through an index of chunks

SIZE, OVER, CHILD, CHILD_OVER, PREFIX = 128, 16, 32, 8, "find: "
HASH = "('0x' || substr(md5(t), 1, 12))::bigint"


def _cfg(**retriever):
    return config.Config(
        chunk=config.Chunk(strategy=retriever.pop("strategy", "fixed"), size_tokens=SIZE, overlap_tokens=OVER, child_size_tokens=CHILD, child_overlap_tokens=CHILD_OVER),
        embedding=config.Embedding(query_prefix=PREFIX),
        retriever=config.Retriever(**retriever),
    )


def _chunk_rows(spark, sf_dir, strategy="fixed"):
    arts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("slug"), _url().alias("source_url"), F.lit("").alias("title"), F.lit("").alias("summary"), F.col("text").alias("body_text"))
    return pipeline.chunks(_cfg(strategy=strategy), arts)


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))


def _retrieved(spark, sf_dir, k, strategy="fixed", **retriever):
    idx = pipeline.index(*_chunk_rows(spark, sf_dir, strategy))
    return pipeline.retrieve(_cfg(strategy=strategy, **retriever), idx, _questions(spark, sf_dir), k)


CHUNKS = f"""
w0 as (select doc_id, {SPC.format("text")} as w from documents),
i0 as (select doc_id, w, unnest(range(0, {_n_windows("len(w)", SIZE, SIZE - OVER)})) as i from w0),
c0 as (select doc_id, doc_id || '::' || i as chunk_id, array_to_string(w[i * {SIZE - OVER} + 1 : i * {SIZE - OVER} + {SIZE}], ' ') as text from i0),
ch as (select *, row_number() over (order by chunk_id) - 1 as position from c0)"""
FAMILY = f"""
w0 as (select doc_id, {SPC.format("text")} as w from documents),
p0 as (select doc_id, w, unnest(range(0, {_n_windows("len(w)", SIZE, SIZE)})) as p from w0),
q0 as (select doc_id, doc_id || '::p' || p as parent_id, w[p * {SIZE} + 1 : p * {SIZE} + {SIZE}] as w from p0),
r0 as (select *, unnest(range(0, {_n_windows("len(w)", CHILD, CHILD - CHILD_OVER)})) as c from q0),
c0 as (select parent_id, parent_id || '::c' || c as chunk_id, array_to_string(w[c * {CHILD - CHILD_OVER} + 1 : c * {CHILD - CHILD_OVER} + {CHILD}], ' ') as text from r0),
ch as (select *, row_number() over (order by chunk_id) - 1 as position from c0)"""


def _vectors(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}t as (select {key}, unnest({TOK.format(text)}) as t from {source}),
{name}d as (select {key}, {HASH} % 256 as dim, sum(case when ({HASH} // 256) % 2 = 1 then -1.0 else 1.0 end)::double as x from {name}t group by all),
{name} as (select {key}, dim, x / sqrt(sum(x * x) over (partition by {key})) as x from {name}d where x <> 0)"""


def _dense_sql(pool: str) -> str:
    """``de``: the dense ranks of ``ch`` for every question, up to a pool."""
    return f"""{_vectors("qv", "benchmark", "item_id", f"'{PREFIX}' || text")},{_vectors("cv", "ch", "position", "text")},
ds as (select item_id, position, sum(qv.x * cv.x) as s from qv join cv using (dim) group by all),
da as (select b.item_id, ch.position, round(coalesce(s, 0), 9) as score from benchmark b cross join ch left join ds on ds.item_id = b.item_id and ds.position = ch.position),
de as (select * from (select item_id as query, position, score, row_number() over (partition by item_id order by score desc, position) as rank from da) where rank <= {pool})"""


def _hybrid_sql(n: int) -> str:
    pool = max(10 * n, 50)
    return f"""with {CHUNKS}, {_dense_sql(str(pool))}, {bm25_sql("ch", "position")},
lx as (select item_id as query, doc_id as position, rank from bm where rank <= {pool}),
fu as (select coalesce(a.query, b.query) as query, coalesce(a.position, b.position) as position, a.rank as ar, b.rank as br from de a full join lx b on a.query = b.query and a.position = b.position),
fs as (select *, coalesce(1.0::double / (60 + ar), 0) + coalesce(1.0::double / (60 + br), 0) as score from fu),
hy as (select query, chunk_id, text, doc_id, score, rank from (select *, row_number() over (partition by query order by score desc, ar asc nulls last, br asc nulls last, position) as rank from fs) join ch using (position) where rank <= {n})"""


@query(f"with {CHUNKS} select chunk_id, position from ch")
def index_positions(spark, sf_dir):
    """Every chunk with its place in the index."""
    return pipeline.index(*_chunk_rows(spark, sf_dir)).rows.select("chunk_id", "position")


@query(f"with {CHUNKS},{_vectors('cv', 'ch', 'position', 'text')} select chunk_id, count(x) as n_dims, round(coalesce(sum(x), 0), 7) as total, round(coalesce(sum(x * x), 0), 7) as length from ch left join cv using (position) group by chunk_id")
def index_vectors(spark, sf_dir):
    """The vectors of an index that was written and read again."""
    at = tables.place(spark, "idx")
    pipeline.index(*_chunk_rows(spark, sf_dir)).write(at)
    v = pipeline.Index.read(spark, at).rows.select("chunk_id", "embedding")
    total = lambda f: F.round(F.aggregate("embedding", F.lit(0.0), f), 7)
    return v.select("chunk_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_dims"), total(lambda s, x: s + x).alias("total"), total(lambda s, x: s + x * x).alias("length"))


@query("with v as (select vec_id, embedding::double[64] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as l from embeddings) select vec_id, round(v[1] / l, 7) as first, round(array_inner_product(v, v) / (l * l), 7) as length from v")
def unit_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", T.unit(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return v.select("vec_id", F.round(F.element_at("u", 1), 7).alias("first"), F.round(T.dot("u", "u"), 7).alias("length"))


@query(f"with {_vectors('qv', 'benchmark', 'item_id', f"'{PREFIX}' || text")} select item_id as query, dim::int as dim, round(x, 7) as x from qv")
def query_vectors(spark, sf_dir):
    """Questions behind the query prefix."""
    q = _questions(spark, sf_dir).withColumn("v", embed.hashed(F.concat(F.lit(PREFIX), F.col("question"))))
    return q.select("query", F.posexplode("v").alias("dim", "x")).where("x <> 0").withColumn("x", F.round("x", 7))


@query(f"with {CHUNKS}, {_dense_sql('5')} select query, rank::int as rank, chunk_id, round(score, 7) as score from de join ch using (position)")
def retrieve_dense(spark, sf_dir):
    """k = 0 means the configured top_k of 5."""
    return _retrieved(spark, sf_dir, 0, type="dense", top_k=5).select("query", "rank", "chunk_id", F.round("score", 7).alias("score"))


@query(_hybrid_sql(5) + " select query, rank::int as rank, chunk_id, round(score, 9) as score from hy")
def rrf_fusion(spark, sf_dir):
    """Dense and BM25 ranks of the same chunks fused: what the hybrid retriever returns."""
    return _retrieved(spark, sf_dir, 5, type="hybrid").select("query", "rank", "chunk_id", F.round("score", 9).alias("score"))


@query(_hybrid_sql(20) + f""", se as (select query, chunk_id, hy.rank, list_distinct({TOK.format("b.text")}) as a, list_distinct({TOK.format("hy.text")}) as c from hy join benchmark b on b.item_id = hy.query),
sj as (select query, chunk_id, rank, round(case when len(a) + len(c) = 0 then 0 else len(list_intersect(a, c))::double / len(list_distinct(list_concat(a, c))) end, 9) as s from se),
sr as (select *, row_number() over (partition by query order by s desc, rank) as final from sj)
select query, final::int as rank, chunk_id, round(s, 7) as rerank_score from sr where final <= 5""")
def retrieve_reranked(spark, sf_dir):
    """Twenty hybrid candidates, the best five by the pair scorer."""
    return _retrieved(spark, sf_dir, 5, type="hybrid", reranker_enabled=True, rerank_top_n=20).select("query", "rank", "chunk_id", F.round("rerank_score", 7).alias("rerank_score"))


@query(f"""with {FAMILY}, {_dense_sql('50')},
pp as (select query, parent_id, score, row_number() over (partition by query, parent_id order by rank) as n, rank from de join ch using (position)),
pr as (select query, parent_id, score, row_number() over (partition by query order by rank) as rank from pp where n = 1)
select query, rank::int as rank, parent_id as chunk_id, round(score, 7) as score from pr where rank <= 5""")
def retrieve_parents(spark, sf_dir):
    """Children are searched, their parents returned."""
    return _retrieved(spark, sf_dir, 5, strategy="small_to_big", type="dense").select("query", "rank", "chunk_id", F.round("score", 7).alias("score"))


@query(f"""with {FAMILY}, {_dense_sql('50')}, {bm25_sql("ch", "position")},
lx as (select item_id as query, doc_id as position, rank from bm where rank <= 50),
fu as (select coalesce(a.query, b.query) as query, coalesce(a.position, b.position) as position, a.rank as ar, b.rank as br from de a full join lx b on a.query = b.query and a.position = b.position),
fs as (select *, coalesce(1.0::double / (60 + ar), 0) + coalesce(1.0::double / (60 + br), 0) as score from fu)
select query, rank::int as rank, chunk_id from (select *, row_number() over (partition by query order by score desc, ar asc nulls last, br asc nulls last, position) as rank from fs) join ch using (position) where rank <= 3""")
def retrieve_hybrid_children(spark, sf_dir):
    """Hybrid search is told apart before small-to-big, so it returns children."""
    return _retrieved(spark, sf_dir, 3, strategy="small_to_big", type="hybrid").select("query", "rank", "chunk_id")


@query(_hybrid_sql(3) + f""", {MATCH.replace("with b as", "mb as").replace("from b where", "from mb where").replace(", d as", ", md as").replace("from d)", "from md)").strip()},
url as (select doc_id, {URL} as u from documents)
select query, rank::int as rank, left(replace(text, chr(10), ' '), 140) as snippet, left(split_part(u, '/', -1), 55) as source from hy join url using (doc_id) where query not in (select item_id from hit)""")
def hybrid_audit(spark, sf_dir):
    """The three best chunks of the questions that no document answers (none holds the item's text)."""
    q = _questions(spark, sf_dir).join(_matches(spark, sf_dir).select(F.col("item_id").alias("query")).distinct(), "query", "left_anti")
    return answers.audit(pipeline.retrieve(_cfg(type="hybrid"), pipeline.index(*_chunk_rows(spark, sf_dir)), q, 3))


# --- answers

@query(_hybrid_sql(2) + f", u as (select doc_id, {URL} as u from documents) select query, max(case when rank = 1 then text end) as answer, array_to_string(list_sort(list_distinct(list(u))), ' ') as sources from hy join u using (doc_id) group by query")
def answer_questions(spark, sf_dir):
    """The offline generator's answers, with the sources of all hits."""
    idx = pipeline.index(*_chunk_rows(spark, sf_dir))
    q = _questions(spark, sf_dir)
    return pipeline.answer(_cfg(type="hybrid"), idx, q, k=2).select("query", "answer", F.array_join("sources", " ").alias("sources"))


@query("with " + bm25_sql() + f""", t as (select doc_id, {URL} as u, text from documents)
select item_id as query, 'doc ' || doc_id as title, '' as date, round(score, 4) as score, u as source_url, left(text, 800) as text, rank::int as rank from bm join t using (doc_id) where rank <= 2""")
def demo_provenance(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select(_url().alias("source_url"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("date"))
    return answers.demo_rows(_hits(spark, sf_dir, 2), titles)


@query("with " + bm25_sql() + f""", h as (select item_id, list(doc_id order by rank) as ids, array_to_string(list_sort(list_distinct(list({URL}))), ' ') as sources, list(left(text, 800) order by rank)[1] as first from bm join documents using (doc_id) where rank <= 2 group by item_id),
l as (select item_id from benchmark where item_id not in (select item_id from h))
select item_id as query, item_id % 5 = 0 as adversarial, len(ids)::int as n_chunks, sources, first as first_text from h""")
def demo_cache(spark, sf_dir):
    """Cached answers written as nested JSON and read again; items of a fifth of the ids count as adversarial."""
    hits = _hits(spark, sf_dir, 2)
    titles = table(spark, sf_dir, "documents").select(_url().alias("source_url"), F.lit("t").alias("title"), F.lit("").alias("date"))
    q = _questions(spark, sf_dir)
    answered = q.join(answers.sources(hits), "query").withColumn("answer", F.lit("a"))
    cache = answers.demo_cache(answers.demo_rows(hits, titles), answered, q.where("query % 5 = 0"))
    at = tables.place(spark, "demo")
    answers.write_demo(cache, at, retriever="bm25")
    back = spark.read.schema("query long, adversarial boolean, sources array<string>, chunks array<struct<text:string>>").json(at)
    return back.select("query", "adversarial", F.size("chunks").alias("n_chunks"), F.array_join("sources", " ").alias("sources"), F.element_at("chunks", 1)["text"].alias("first_text"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"select item_id, item_id % 2 = 0 as metadata, md5(case when item_id % 2 = 0 then {_sql_text(answers.SYSTEM + answers.METADATA_RULES)} else {_sql_text(answers.SYSTEM)} end || chr(10) || chr(10) || coalesce(text, '')) as prompt_md5 from benchmark")
def system_prompts(spark, sf_dir):
    """Every benchmark text below its system prompt, that with the rules on metadata for even ids."""
    even = F.col("item_id") % 2 == 0
    p = F.when(even, answers.system_prompt(True)).otherwise(answers.system_prompt(False))
    return table(spark, sf_dir, "benchmark").select("item_id", even.alias("metadata"), F.md5(F.concat(p, F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("prompt_md5"))


@query(rf"""with l as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, '') || chr(10) || '1. Is it known whether this is one?' || chr(10) || 'Why?' || chr(10) || '2) What of a second one?', '\r\n|[\n\r]'), lambda x: regexp_replace(trim(x), '^[0-9.\-) ]+', '')), lambda x: length(trim(x)) > 12 and trim(x)[-1] = '?') as q from documents)
select doc_id, trim(unnest(q[1:2])) as question from l""")
def generated_questions(spark, sf_dir):
    """Documents with numbered lines behind them as the raw output of a question model."""
    raw = F.concat(F.coalesce("text", F.lit("")), F.lit("\n1. Is it known whether this is one?\nWhy?\n2) What of a second one?"))
    return table(spark, sf_dir, "documents").withColumn("raw", raw).select("doc_id", F.explode(training.questions("raw", 2)).alias("question"))


@query(f"""with t as (select item_id, list_distinct({TOK.format("text")}) as k, list_distinct({TOK.format("reverse(coalesce(text, ''))")}) as r from benchmark),
s as (select *, list_distinct(list_concat(k, r)) as a from t)
select 'beyond ' || item_id as control, not (len(a) > 0 and len(list_intersect(a, k)) >= 0.9 * len(a)) as caught from s
union all select 'against ' || item_id, len(k) = 0 or len(list_intersect(k, r)) / len(k)::double < 0.9 from s""")
def judge_controls(spark, sf_dir):
    """Negative controls made of the benchmark's texts, under the offline judge."""
    rows = answers.controls_of(table(spark, sf_dir, "benchmark").withColumn("text", F.coalesce("text", F.lit(""))), "item_id", "text")
    return answers.probe_judge(spark, answers.overlap_judge, rows).select(F.col("case").alias("control"), "caught")


# --- evaluation


@query(MATCH + " select distinct item_id % 7 as item, doc_id from hit")
def any_passage(spark, sf_dir):
    """Benchmark texts as the passages of seven items."""
    p = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 7).alias("item"), "item_id")
    return evaluation.any_of(_matches(spark, sf_dir), p, "item", "item_id", "doc_id")


@query(f"select id, answerable from (select id, answerable, row_number() over (partition by answerable order by id) as n from {GOLD}) where n <= case when answerable then 8 else 2 end")
def limited_items(spark, sf_dir):
    return evaluation.limited(_gold(spark, sf_dir), 8).select("id", "answerable")


@query(f"select id, answerable from {GOLD}")
def answerable_split(spark, sf_dir):
    g = _gold(spark, sf_dir)
    return corpus.answerable(g).unionByName(corpus.unanswerable(g)).select("id", "answerable")


@query(f"with {FAMILY} select count(*) as n_chunks, (select count(*) from documents) as n_articles, round(count(*) / (select count(*) from documents)::double, 1) as chunks_per_article, count(distinct parent_id) as n_parents, round(count(*) / count(distinct parent_id)::double, 1) as children_per_parent from ch")
def chunk_averages(spark, sf_dir):
    return evaluation.chunk_averages(table(spark, sf_dir, "documents"), _chunk_rows(spark, sf_dir, "small_to_big")[0], "source_url", "parent_id")


@query(RANKS + " select '2024-01-02T03:04:05' as timestamp, 'retrieval' as tag, count(*) as n, count(*) filter (where r <= 5) as recall_at_5, count(r) as n_found from rr")
def result_row(spark, sf_dir):
    """A run's row, written and read again."""
    ranks = _ranks(spark, sf_dir)
    row = pipeline.result_row(evaluation.retrieval_metrics(ranks), ranks, config.Config(), "2024-01-02T03:04:05", "v1+corpus:x")
    path = pipeline.write_result(row, tables.place(spark, "results"))
    back = spark.read.schema("timestamp string, tag string, metrics struct<n:long,recall_at_5:long>, per_item array<struct<query:long,first_relevant_rank:long>>").json(path)
    return back.select("timestamp", "tag", "metrics.n", "metrics.recall_at_5", F.size(F.filter("per_item", lambda x: x["first_relevant_rank"].isNotNull())).cast("long").alias("n_found"))


# --- chunking through whole strategies

SECT = "regexp_split_to_array(coalesce(text, ''), '\\n+')"
FLOOR, CAP, CAP_OVER = 6, 40, 8
MERGED = f"""with recursive s0 as (select doc_id, source, {SECT} as s from documents where text is not null),
f as (select doc_id, 0 as i, [] :: varchar[] as out, null :: varchar as carry from s0
union all
select f.doc_id, i + 1,
case when len({SPC.format("x")}) >= {FLOOR} then list_append(out, x) when len(out) > 0 then list_append(out[1 : len(out) - 1], out[len(out)] || chr(10) || x) else out end,
case when len({SPC.format("x")}) < {FLOOR} and len(out) = 0 then x end
from (select f.*, case when carry is null then s[i + 1] else carry || chr(10) || s[i + 1] end as x, len(s) as n from f join s0 using (doc_id) where i < len(s)) f),
mg as (select f.doc_id, case when carry is null then out else list_append(out, carry) end as m from f join s0 using (doc_id) where i = len(s))"""


def _sectioned(spark, sf_dir):
    """Documents as articles whose lines are sections."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.split("text", "\n+").alias("sections"))


@query(MERGED + " select doc_id, len(m)::int as n, md5(array_to_string(m, '|')) as sections_md5 from mg")
def merged_sections(spark, sf_dir):
    m = _sectioned(spark, sf_dir).select("doc_id", chunking.merge_small(F.col("sections"), FLOOR).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.md5(F.array_join("m", "|")).alias("sections_md5"))


CAPPED = f"""sx as (select doc_id, unnest(range(0, len(m))) as section, unnest(m) as x from mg),
sw as (select *, {SPC.format("x")} as w from sx),
sp as (select *, unnest(range(0, case when len(w) <= {CAP} then 1 else {_n_windows("len(w)", CAP, CAP - CAP_OVER)} end)) as piece from sw),
st as (select doc_id, section, piece, case when len(w) <= {CAP} then x else array_to_string(w[piece * {CAP - CAP_OVER} + 1 : piece * {CAP - CAP_OVER} + {CAP}], ' ') end as text from sp),
sc2 as (select doc_id, section::int as section, doc_id || '::' || (row_number() over (partition by doc_id order by section, piece) - 1) as chunk_id, text from st where trim(text, ' ') <> '')"""


@query(MERGED + ", " + CAPPED + " select doc_id, section, chunk_id, text from sc2")
def chunk_header_aware(spark, sf_dir):
    return chunking.header_aware(_sectioned(spark, sf_dir), "doc_id", "sections", CAP, CAP_OVER, FLOOR).withColumnRenamed("id", "doc_id")


@query(MERGED + ", " + CAPPED + f""", k as (select doc_id, count(*) as c from sc2 group by doc_id), g as (select s0.source, mg.doc_id, len(m) as n, len(list_filter(m, lambda x: len({SPC.format("x")}) > {CAP})) as cap from mg join s0 using (doc_id))
select source, count(*) as n_articles, sum(n)::bigint as n_sections, sum(coalesce(c, 0))::bigint as n_chunks, sum(cap)::bigint as n_capped from g left join k using (doc_id) group by source""")
def section_stats(spark, sf_dir):
    """Sources stand for subtypes."""
    return chunking.section_stats(_sectioned(spark, sf_dir), "doc_id", "source", "sections", CAP, CAP_OVER, FLOOR)[0]


@query(f"""with e as (select label, vec_id, embedding::double[64] as v, lead(embedding::double[64]) over (partition by label order by vec_id) as n from embeddings),
g as (select label, vec_id, 1 - array_inner_product(v, n) as gap from e where n is not null), th as (select label, quantile_cont(gap, 0.9) as t from g group by label),
c as (select e.label, e.vec_id, coalesce((g.gap > th.t)::int, 0) as c from e left join g using (label, vec_id) left join th on th.label = e.label),
p as (select label, vec_id, coalesce(sum(c) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as part from c),
j as (select label, part, string_agg('Word' || vec_id || ' of it', ' ' order by vec_id) as x from p group by all), w as (select *, {SPC.format("x")} as w from j),
q as (select *, unnest(range(0, case when len(w) <= {CAP} then 1 else {_n_windows("len(w)", CAP, CAP - CAP_OVER)} end)) as piece from w)
select label, part::bigint as part, piece::int as piece, case when len(w) <= {CAP} then x else array_to_string(w[piece * {CAP - CAP_OVER} + 1 : piece * {CAP - CAP_OVER} + {CAP}], ' ') end as text from q""")
def chunk_semantic(spark, sf_dir):
    """A label's vectors are an article's sentences; groups too long for a chunk become windows."""
    s = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.concat(F.lit("Word"), F.col("vec_id").cast("string"), F.lit(" of it")).alias("sentence"), "embedding")
    return chunking.semantic(s, "label", "vec_id", "sentence", "embedding", CAP, CAP_OVER).select("label", "part", "piece", "text")


@query("select doc_id, array_to_string(list_filter([source, lang, text], lambda x: x <> ''), chr(10)) as text from documents")
def assembled_text(spark, sf_dir):
    """Source, language and text as title, summary and body."""
    return table(spark, sf_dir, "documents").select("doc_id", T.assembled("source", "lang", "text").alias("text"))


# --- pages, sinks and checks


def _entities(x: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"regexp_replace({x}, '{name}?', '{sign}', 'g')"  # these need no semicolon
    return x


BODY_SQL = r"list_filter(list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<!--[^>]*-->|<[^>]*>'), lambda x: " + _entities(r"regexp_replace(x, '^\s+|\s+$', '', 'g')") + "), lambda x: x <> '')"


@query(f"with b as (select page_id, {BODY_SQL} as t from pages) select page_id, md5(array_to_string(t, chr(10))) as body_md5, len(t) as n_nodes from b where len(t) > 0")
def article_body(spark, sf_dir):
    """Text nodes of a page's article element."""
    x = corpus.extract(table(spark, sf_dir, "pages"), "html", body=("article",)).where("article.body <> ''")
    return x.select("page_id", F.md5("article.body").alias("body_md5"), F.size(F.split("article.body", "\n")).cast("long").alias("n_nodes"))


def _manifest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", T.last_segment("url").alias("slug"), F.lit(None).cast("string").alias("title"), F.lit("2024-01-01").alias("published_date"))


@query("select url, split_part(url, '/', -1) as slug, null::varchar as title, '2024-01-01' as published_date from pages")
def manifest_round_trip(spark, sf_dir):
    at = tables.place(spark, "manifest")
    corpus.write_lines(_manifest(spark, sf_dir), at)
    return corpus.read_lines(spark, at, "manifest")


@query("with p as (select split_part(url, '/', -1) as slug, url, page_id from pages) select slug, url, left(slug, 80) || '-' || left(md5(slug), 8) || '.html' as name from p where slug not in (select slug from p where page_id % 3 = 0)")
def pages_to_fetch(spark, sf_dir):
    """A third of the pages is cached already."""
    p = table(spark, sf_dir, "pages")
    cached = p.where("page_id % 3 = 0").select(T.raw_name(T.last_segment("url")).alias("name"))
    return corpus.to_fetch(_manifest(spark, sf_dir), cached).select("slug", "url", "name")


@query("with p as (select split_part(url, '/', -1) as slug, page_id from pages) select distinct slug from p where slug not in (select slug from p where page_id % 10 <> 0)")
def missing_pages(spark, sf_dir):
    """A tenth of the pages was never fetched."""
    p = table(spark, sf_dir, "pages")
    return corpus.missing_pages(_manifest(spark, sf_dir), p.where("page_id % 10 <> 0").select(T.last_segment("url").alias("slug"), "html"))


@query(f"select source_url, slug, published_date, coalesce(text, '') as body_text from {ART}")
def articles_round_trip(spark, sf_dir):
    a = _articles(spark, sf_dir).select("source_url", "slug", F.lit("").alias("title"), F.lit("").alias("summary"), F.coalesce("text", F.lit("")).alias("body_text"), "published_date")
    at = tables.place(spark, "articles")
    corpus.write_lines(a, at)
    return corpus.read_lines(spark, at, "articles").select("source_url", "slug", "published_date", "body_text")


@query(f"with {FAMILY}, f as (select chunk_id, parent_id, text from ch) select chunk_id, f.parent_id, f.text, md5(array_to_string(q0.w, ' ')) as parent_md5 from f join q0 using (parent_id)")
def chunks_with_parents(spark, sf_dir):
    """Children and parents as JSON lines, read again and joined by the parent's id."""
    rows, parents = _chunk_rows(spark, sf_dir, "small_to_big")
    a, b = tables.place(spark, "chunks"), tables.place(spark, "parents")
    corpus.write_lines(rows, a)
    corpus.write_lines(parents, b)
    big = corpus.read_lines(spark, b, "parents").select("parent_id", F.md5("text").alias("parent_md5"))
    return corpus.read_lines(spark, a, "chunks").join(big, "parent_id").select("chunk_id", "parent_id", "text", "parent_md5")


SNAP = f"(select left(sha256(array_to_string(list_sort(list(slug)), chr(10))), 12) as snapshot_id, count(*) as n_articles, min(nullif(published_date, '')) as date_min, max(nullif(published_date, '')) as date_max from {ART})"


@query(f"select s.*, 'v2+corpus:' || snapshot_id as stamp, 'v2+corpus:unknown' as stamp_without from {SNAP} s")
def snapshot_round_trip(spark, sf_dir):
    """A snapshot written and read again, and the stamps of gold sets with and without one."""
    at = tables.place(spark, "snapshot")
    corpus.write_snapshot(corpus.snapshot(_articles(spark, sf_dir), "slug", "published_date"), at)
    s = corpus.load_snapshot(spark, at)
    return s.withColumn("stamp", F.lit(corpus.gold_stamp("v2", s))).withColumn("stamp_without", F.lit(corpus.gold_stamp("v2", None)))


@query(f"select id, 'u' || (id::bigint % 3) as source_url, text as passage_text from {GOLD} where has_passage")
def gold_passages(spark, sf_dir):
    return training.gold_passages(_gold(spark, sf_dir))


def _pairs_read(spark, sf_dir):
    at = tables.place(spark, "pairs")
    corpus.write_lines(training.pairs(*_pairs(spark, sf_dir)), at)
    return corpus.read_lines(spark, at, "pairs")


from .catalogue import NEG  # noqa: E402


@query(NEG + ", pa as (select item_id, doc_id, 1 as label from pos union all select item_id, doc_id, 0 from ng) select label::int as label, count(*) as n from pa group by label")
def pair_counts(spark, sf_dir):
    """Training pairs written and read again, counted by label."""
    return training.pair_counts(_pairs_read(spark, sf_dir))


@query(f"select source_url, published_date as date, {SUB} as subtype, split_part(slug, '-', 1) as drug_or_device, {REG.replace('lower(t)', 'lower(text)')} as register from {ART} where text is not null")
def article_metadata(spark, sf_dir):
    a = _articles(spark, sf_dir).where("text is not null")
    return answers.article_metadata(a, "source_url", "slug", "published_date").join(a.select("source_url", T.register("text").alias("register")), "source_url")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events where ts is not null group by all")
def windowed_counts(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))
