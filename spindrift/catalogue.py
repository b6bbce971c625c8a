"""Named queries over the tables of a folder, and the SQL that gives the same rows.

Each query runs an operator of this package over whole tables. Where a query
needs a role that the tables don't have by name (articles, chunks, gold items),
its docstring says which table plays it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import read, tables
from .functions import text as T
from .operators import answers, chunking, evaluation, retrieval, training
from .sources import corpus

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL parts that several oracles share

NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
SPC = r"regexp_extract_all(lower(coalesce({}, '')), '\S+')"
SENT = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({}, ''), '([.!?])\s+([A-Z0-9("''])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def _n_windows(n: str, size: int, stride: int) -> str:
    return f"(case when {n} <= 0 then 0 when {n} <= {size} then 1 else ceil(({n} - {size}) / {stride}.0)::int + 1 end)"


# --- chunking

SIZE, OVER, CHILD, CHILD_OVER = 64, 16, 16, 4


@query(f"""
with t as (select doc_id, {SPC.format("text")} as w from documents),
i as (select doc_id, w, unnest(range(0, {_n_windows("len(w)", SIZE, SIZE - OVER)})) as i from t)
select doc_id, i::int as chunk_no, doc_id || '::' || i as chunk_id, array_to_string(w[i * {SIZE - OVER} + 1 : i * {SIZE - OVER} + {SIZE}], ' ') as text from i
""")
def chunk_fixed_windows(spark, sf_dir):
    return chunking.fixed(table(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVER).withColumnRenamed("id", "doc_id")


@query(f"""
with t as (select doc_id, {SPC.format("text")} as w from documents),
p as (select doc_id, w, unnest(range(0, {_n_windows("len(w)", SIZE, SIZE)})) as p from t),
q as (select doc_id, p, w[p * {SIZE} + 1 : p * {SIZE} + {SIZE}] as w from p),
c as (select doc_id, p, w, unnest(range(0, {_n_windows("len(w)", CHILD, CHILD - CHILD_OVER)})) as c from q)
select doc_id || '::p' || p as parent_id, doc_id || '::p' || p || '::c' || c as chunk_id, array_to_string(w[c * {CHILD - CHILD_OVER} + 1 : c * {CHILD - CHILD_OVER} + {CHILD}], ' ') as text from c
""")
def chunk_parent_child(spark, sf_dir):
    return chunking.small_to_big(table(spark, sf_dir, "documents"), "doc_id", "text", SIZE, CHILD, CHILD_OVER)[1].select("parent_id", "chunk_id", "text")


@query(f"""
with s as (select doc_id, {SENT.format("text")} as s from documents)
select doc_id, unnest(range(0, len(s)))::int as i, unnest(s) as sentence from s
""")
def chunk_sentences(spark, sf_dir):
    return chunking.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(f"""
with s as (select doc_id, {SENT.format("text")} as s from documents),
i as (select doc_id, s, unnest(range(0, len(s))) as i from s)
select doc_id, i::int as i, array_to_string(s[greatest(i, 1) : i + 2], ' ') as buffered from i
""")
def chunk_sentence_buffer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.buffered(T.sentences("text"))).alias("i", "buffered"))


GAPS = """
with v as (select label, vec_id, embedding::double[64] as v, lead(embedding::double[64]) over (partition by label order by vec_id) as n from embeddings),
g as (select label, vec_id, 1 - array_inner_product(v, n) as gap from v where n is not null)"""


@query(GAPS + " select label, vec_id, round(gap, 7) as gap from g")
def semantic_gaps(spark, sf_dir):
    """A label is an article, its vectors in order of vec_id the sentences."""
    return chunking.gaps(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("gap", F.round("gap", 7))


@query(GAPS + " select label, round(quantile_cont(gap, 0.9), 7) as threshold from g group by label")
def semantic_threshold(spark, sf_dir):
    g = chunking.gaps(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return chunking.thresholds(g, "label").withColumn("threshold", F.round("threshold", 7))


@query(GAPS + """, t as (select label, quantile_cont(gap, 0.9) as t from g group by label),
c as (select e.label, e.vec_id, coalesce((g.gap > t.t)::int, 0) as c from embeddings e left join g on g.vec_id = e.vec_id and g.label = e.label left join t on t.label = e.label)
select label, vec_id, coalesce(sum(c) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0)::bigint as part from c""")
def semantic_groups(spark, sf_dir):
    return chunking.semantic_groups(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(f"""
with t as (select source, {_n_windows(f"len({SPC.format('text')})", SIZE, SIZE - OVER)} as n from documents)
select source, count(*) as n_articles, sum(n)::bigint as n_chunks, count(*) filter (where n > 1) as n_capped from t group by source
""")
def chunk_stats(spark, sf_dir):
    """Sources stand for subtypes."""
    return chunking.stats(table(spark, sf_dir, "documents"), "source", "text", SIZE, OVER)


# --- retrieval



def idf_sql(source: str = "documents", item: str = "doc_id") -> str:
    """d, tot, df, lo, idf: the vocabulary's counts and weights."""
    return f"""d as (select {item} as doc_id, {TOK.format("text")} as w from {source}),
tot as (select count(*) as n, avg(len(w)) as avgdl from d),
df as (select term, count(*) as df from (select doc_id, unnest(list_distinct(w)) as term from d) group by term),
rawidf as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from df, tot),
lo as (select avg(r) * 0.25 as low from rawidf),
idf as (select term, df, case when r < 0 then low else r end as idf from rawidf, lo)"""


def bm25_sql(source: str = "documents", item: str = "doc_id", asked: str = "benchmark", query: str = "item_id") -> str:
    """d, tot, df, lo, idf, q, tf, sc, al, bm: every item ranked for every query; ``bm`` has (query, doc_id, score, rank) under the query's own name."""
    return f"""{idf_sql(source, item)},
q as (select {query}, term, count(*) as times from (select {query}, unnest({TOK.format("text")}) as term from {asked}) group by all),
tf as (select doc_id, len(w) as dl, term, count(*) as tf from (select doc_id, w, unnest(w) as term from d) where term in (select term from q) group by all),
sc as (select {query}, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from tf join q using (term) join idf using (term), tot group by all),
al as (select x.{query}, d.doc_id, coalesce(score, 0) as score from (select distinct {query} from {asked}) x cross join d left join sc on sc.{query} = x.{query} and sc.doc_id = d.doc_id),
bm as (select {query}, doc_id, score, row_number() over (partition by {query} order by score desc, doc_id) as rank from al)"""


IDF_SQL = idf_sql()
BM25 = "with " + bm25_sql()
BEST = 5


@query("with " + IDF_SQL + " select term, df, round(idf, 7) as idf from idf")
def bm25_idf(spark, sf_dir):
    return retrieval.Lexical(table(spark, sf_dir, "documents"), "doc_id", "text").idf.withColumn("idf", F.round("idf", 7))


def _bm25(spark, sf_dir, k):
    lexical = retrieval.Lexical(table(spark, sf_dir, "documents"), "doc_id", "text")
    hits = lexical.top(table(spark, sf_dir, "benchmark"), "item_id", "text", k)
    lexical.reset()
    return hits


@query(BM25 + f" select item_id, doc_id, round(score, 6) as score, rank::int as rank from bm where rank <= {BEST}")
def bm25_topk(spark, sf_dir):
    """Every benchmark text against all documents."""
    return _bm25(spark, sf_dir, BEST).select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _dense_sql(queries: str = "") -> str:
    """Every vector, or those of the condition ``queries``, against all."""
    return f"""
with e as (select vec_id, embedding::double[64] as v from embeddings),
s as (select q.vec_id as query, e.vec_id as item, round(array_inner_product(q.v, e.v), 9) as score from e q, e{queries}),
de as (select *, row_number() over (partition by query order by score desc, item) as rank from s)"""


DENSE = _dense_sql(" where q.vec_id % 20 = 0")


@query(DENSE + " select query, item, round(score, 7) as score, rank::int as rank from de where rank <= 10")
def dense_topk(spark, sf_dir):
    """Queries: the vectors whose id is divisible by 20, against all."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense(e.where("vec_id % 20 = 0"), e, 10, "vec_id", "vec_id", "embedding").withColumn("score", F.round("score", 7))


@query(_dense_sql() + """,
p as (select *, item // 4 as parent from de where rank <= 50),
b as (select *, row_number() over (partition by query, parent order by rank) as n from p),
r as (select query, parent, item as matched_child, score, row_number() over (partition by query order by rank) as rank from b where n = 1)
select query, parent, matched_child, round(score, 7) as score, rank::int as rank from r where rank <= 5""")
def dense_parent_collapse(spark, sf_dir):
    """Every vector against all. Four vectors in a row are the children of a parent."""
    # each block of queries reads the table again: dealt evenly, whatever its files and row groups
    e = tables.cut(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism), "vectors")
    hits = retrieval.dense(e, e, 50, "vec_id", "vec_id", "embedding").withColumn("parent", F.floor(F.col("item") / 4))
    parents = e.select(F.floor(F.col("vec_id") / 4).alias("parent")).distinct()
    # as DuckDB rounds, in binary: 0.41766665 is 0.4176666 there, and 0.4176667 by Spark's round to 7 places
    return retrieval.collapse(hits, parents, 5).withColumn("score", F.round(F.col("score") * 1e7) / 1e7)


JAC = f"""
h as (select bm.item_id, bm.doc_id, bm.rank as base_rank, list_distinct({TOK.format("b.text")}) as a, list_distinct({TOK.format("x.text")}) as c from bm join benchmark b using (item_id) join documents x using (doc_id) where bm.rank <= 50),
j as (select item_id, doc_id, base_rank, round(case when len(a) + len(c) = 0 then 0 else len(list_intersect(a, c))::double / len(list_distinct(list_concat(a, c))) end, 9) as s from h),
k as (select *, row_number() over (partition by item_id order by s desc, base_rank) as rank from j)"""


@query(BM25 + "," + JAC + f" select item_id, doc_id, round(s, 7) as rerank_score, rank::int as rank from k where rank <= {BEST}")
def rerank_overlap(spark, sf_dir):
    """The 50 best by BM25, reordered by the built-in pair scorer."""
    hits = _bm25(spark, sf_dir, 50)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("t"))
    out = retrieval.rerank(hits.join(b, "query").join(d, "item"), retrieval.overlap_score("q", "t"), BEST)
    return out.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.round("rerank_score", 7).alias("rerank_score"), "rank")


URL = "'https://example.org/' || coalesce(source, '') || '/' || lang || '-' || doc_id"


def _url():
    return F.concat(F.lit("https://example.org/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"))


def _hits(spark, sf_dir, k):
    """BM25 hits with text and a made-up source_url."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", _url().alias("source_url"))
    return _bm25(spark, sf_dir, k).join(d, "item")


@query(f"select doc_id, {NORM.format('text')} as norm from documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("norm"))


MATCH = f"""
with b as (select item_id, {NORM.format("text")} as np from benchmark), d as (select doc_id, {NORM.format("text")} as nd from documents),
bt as (select item_id, np, string_split(np, ' ') as t from b where np <> ''), dt as (select doc_id, nd, list_distinct(string_split(nd, ' ')) as s from d),
hit as (select distinct item_id, doc_id from bt, dt where contains(nd, np) or len(list_filter(t, lambda x: list_contains(s, x))) >= 0.9 * len(t) - 1e-9)"""


def _matches(spark, sf_dir):
    return evaluation.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(MATCH + " select item_id, doc_id from hit")
def passage_containment(spark, sf_dir):
    return _matches(spark, sf_dir)


RANKS = MATCH.replace("with b as", "with b0 as", 1).replace("from b where", "from b0 where").replace(", d as", ", d0 as", 1).replace("from d)", "from d0)") + ",\n" + bm25_sql() + """,
fr as (select item_id, min(rank) as r from (select * from bm where rank <= 10) join hit using (item_id, doc_id) group by item_id),
rr as (select item_id, r from benchmark left join fr using (item_id))"""


def _ranks(spark, sf_dir):
    m = _matches(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"))
    return evaluation.first_relevant(_bm25(spark, sf_dir, 10), m, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")))


@query(RANKS + " select item_id as query, r::int as first_relevant_rank from rr")
def first_relevant_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(RANKS + " select count(*) as n, " + ", ".join(f"count(*) filter (where r <= {k}) as recall_at_{k}" for k in (1, 3, 5, 10)) + ", round(sum(coalesce(1.0::double / r, 0)) / count(*), 4) as mrr from rr")
def recall_at_k(spark, sf_dir):
    """recall@k and MRR of BM25 over the benchmark texts."""
    return evaluation.retrieval_metrics(_ranks(spark, sf_dir))


@query("""select lang, count(*) filter (where quality = 1) as n, count(*) as d, round_even(100.0::double * count(*) filter (where quality = 1) / count(*), 1) as pct,
count(*) filter (where quality = 1) || '/' || count(*) || ' (' || round_even(100.0::double * count(*) filter (where quality = 1) / count(*), 0)::int || '%)' as label from labels join documents using (doc_id) group by lang""")
def count_ratio(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(evaluation.count_ratio(F.count_if(F.col("quality") == 1), F.count("*")).alias("r")).select("lang", "r.*")


@query("""
with r as (select quality = 1 as a, doc_id % 7 = 0 as r, case doc_id % 4 when 0 then 'correct' when 1 then 'incomplete' when 2 then 'wrong' else 'maybe' end as l, toxic = 0 as f from labels),
s as (select a, r, f, case when r then 'incomplete' when l = 'maybe' then 'wrong' else l end as l from r)
select count(*) filter (where a and l = 'correct') as correct, count(*) filter (where a and l = 'incomplete') as incomplete, count(*) filter (where a and l = 'wrong') as wrong,
count(*) filter (where a and not r) as answered, count(*) filter (where a and not r and f) as faithful, count(*) filter (where not a and r) as refused_unanswerable, count(*) filter (where not a) as unanswerable,
count(*) filter (where a and r) as false_refusals, count(*) filter (where not a and not r) as false_answers from s
""")
def label_histogram(spark, sf_dir):
    """Labels stand for judged answers: quality for answerable, toxic for unfaithful; refusals and verdicts come from the id."""
    lab = F.when(F.col("doc_id") % 4 == 0, "correct").when(F.col("doc_id") % 4 == 1, "incomplete").when(F.col("doc_id") % 4 == 2, "wrong").otherwise("maybe")
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("doc_id") % 7 == 0).alias("refused"), lab.alias("label"), (F.col("toxic") == 0).alias("faithful"))
    return evaluation.answer_counts(rows)


@query(f"select conv_id, turn, coalesce(contains({NORM.format('text')}, '{T.REFUSAL_SIGN}'), false) as refused from conversations")
def refusal_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal("text").alias("refused"))


LAT = """
with s as (select event_type, list_sort(list(value)) as v, count(*) as n from events where value is not null group by event_type),
l as (select event_type, n, round(list_aggregate(v, 'median'), 2) as median_s, round(v[round_even(0.95 * (n - 1), 0)::int + 1], 2) as p95_s, round(v[1], 2) as min_s, round(v[n], 2) as max_s from s)"""


@query(LAT + " select * from l")
def latency_summary(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query(LAT + " select a.event_type as retrieval, b.event_type as generation, round(a.median_s + b.median_s, 2) as end_to_end_s from l a join l b on a.event_type < b.event_type")
def end_to_end_latency(spark, sf_dir):
    """Sums of medians for each pair of event types, standing for retrieval and generation."""
    s = evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return evaluation.end_to_end(s, s, "event_type").where("retrieval < generation")


@query("""
with s as (select lang, doc_id, quality = 1 as hit, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from labels join documents using (doc_id)),
c as (select *, sum(hit::int) over (partition by lang order by rank) as hits from s)
select lang, round(coalesce(avg(case when hit then hits::double / rank end), 0), 7) as average_precision, count(*) filter (where hit) as positives from c group by lang""")
def average_precision(spark, sf_dir):
    """Ranks labelled documents by length within a language; quality is relevance."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return evaluation.average_precision(j, "lang", "doc_id", "n_chars", "quality").withColumn("average_precision", F.round("average_precision", 7))


@query("""
with a as (select doc_id, quality as v from labels), b as (select doc_id, (n_chars > 2000)::int as v from documents),
j as (select coalesce(a.doc_id, b.doc_id) as doc_id, a.v as before, b.v as after, a.doc_id is null as na, b.doc_id is null as nb from a full join b on a.doc_id = b.doc_id)
select doc_id, before, after, case when na then 'added' when nb then 'removed' when before is null then 'gained' when after is null then 'lost' when after < before then 'better' else 'worse' end as change
from j where na or nb or before is distinct from after""")
def run_diff(spark, sf_dir):
    """Two runs: labelled quality before, whether a document is long after."""
    after = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("v"))
    return evaluation.run_diff(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v")), after, "doc_id", "v")


@query("select count(*) filter (where quality = 1) as passed_off, count(*) filter (where toxic = 0) as passed_on, count(*) filter (where toxic = 0) - count(*) filter (where quality = 1) as delta, count(*) filter (where toxic = 0 and quality <> 1) as fixed, count(*) filter (where toxic <> 0 and quality = 1) as broken from labels")
def probe_flips(spark, sf_dir):
    """Quality stands for a probe passed without metadata, not toxic for one passed with it."""
    lab = table(spark, sf_dir, "labels")
    return evaluation.probe_flips(lab.select("doc_id", (F.col("quality") == 1).alias("ok")), lab.select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "ok")


# --- pages and articles


@query(r"select page_id, trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) as title from pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", corpus.title_of("html").alias("title"))


@query("select page_id, array_to_string(list_filter([" + ", ".join(f"'{m}'" for m in T.BOILERPLATE) + "], lambda m: contains(lower(coalesce(html, '')), m)), ',') as found from pages")
def boilerplate_violations(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.boilerplate_found("html"), ",").alias("found"))


SKEL = r"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(html, '')), '<(h2|h3|h4|p|ul|ol|li|table|div)[\s>/]', 1))), ',')"


@query(f"select page_id, {SKEL} as tags from pages")
def page_skeleton(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(corpus.skeleton("html"), ",").alias("tags"))


@query(rf"""
with s as (select page_id, [regexp_matches(lower(html), '<h1[\s>]'), contains(lower(html), 'gem-c-lead-paragraph'), regexp_matches(lower(html), '<article[\s>]|govspeak')] as s, {SKEL} as tags from pages)
select a.s = b.s as same, a.tags as oldest_tags, b.tags as newest_tags from s a, s b where a.page_id = (select min(page_id) from pages) and b.page_id = (select max(page_id) from pages)""")
def oldest_newest_skeleton(spark, sf_dir):
    return corpus.same_structure(table(spark, sf_dir, "pages"), "page_id", "html")


@query("select page_id, left(split_part(url, '/', -1), 80) || '-' || left(md5(split_part(url, '/', -1)), 8) || '.html' as name from pages")
def raw_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.raw_name(T.last_segment("url")).alias("name"))


@query("""
with r as (select url, '2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-01T00:00:00' as stamp from pages)
select url, split_part(url, '/', -1) as slug, left(stamp, 10) as published_date from r where starts_with(url, 'http') and left(stamp, 10) between '2024-03-01' and '2024-10-31' order by published_date, url limit 200""")
def source_filter(spark, sf_dir):
    """Pages as search results, stamped by a date made of the id; the limit is the source's own count."""
    r = table(spark, sf_dir, "pages").withColumn("stamp", F.concat(F.lit("2024-"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-01T00:00:00")))
    return corpus.select_links(r, "url", "stamp", "http", "2024-03-01", "2024-10-31", 200)


SLUG = "case doc_id % 5 when 0 then 'letters-and-medicine-recalls-' when 1 then 'covid-19-' when 2 then 'safety-roundup-' when 3 then 'medsafetyweek-' else coalesce(source, '') || '-' end || doc_id"
SUB = "case when starts_with(slug, 'letters-and-medicine-recalls') then 'bulletin' when starts_with(slug, 'covid-19') or contains(slug, 'medsafetyweek') or starts_with(slug, 'safety-roundup') then 'roundup' else 'standalone' end"


def _slug():
    k = F.col("doc_id") % 5
    p = F.when(k == 0, "letters-and-medicine-recalls-").when(k == 1, "covid-19-").when(k == 2, "safety-roundup-").when(k == 3, "medsafetyweek-").otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit("-")))
    return F.concat(p, F.col("doc_id").cast("string"))


def _articles(spark, sf_dir):
    """Documents as articles with made-up slugs and dates."""
    day = F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-15"))
    return table(spark, sf_dir, "documents").select("doc_id", _url().alias("source_url"), _slug().alias("slug"), day.alias("published_date"), "text", "source")


ART = f"(select doc_id, {URL} as source_url, {SLUG} as slug, '2024-' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '-15' as published_date, text, source from documents)"


@query(f"select doc_id, {SUB} as subtype, split_part(slug, '-', 1) as topic from {ART}")
def subtype_case(spark, sf_dir):
    return _articles(spark, sf_dir).select("doc_id", T.subtype("slug").alias("subtype"), T.topic("slug").alias("topic"))


REG = f"(case when contains(lower(t), '{T.HCP_MARKER}') and regexp_matches(lower(t), '{T.PATIENT_PATTERN}') then 'HCP+patient' when contains(lower(t), '{T.HCP_MARKER}') then 'HCP' when regexp_matches(lower(t), '{T.PATIENT_PATTERN}') then 'patient' else 'general' end)"


@query(f"with x as (select doc_id, case doc_id % 4 when 0 then 'Advice for healthcare professionals: ' when 1 then 'Advice for patients: ' when 2 then 'Advice for Healthcare Professionals to give to patients: ' else '' end || coalesce(text, '') as t from documents) select doc_id, {REG} as register from x")
def register_case(spark, sf_dir):
    """Documents, three in four with an audience heading put before them."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "Advice for healthcare professionals: ").when(k == 1, "Advice for patients: ").when(k == 2, "Advice for Healthcare Professionals to give to patients: ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.register(F.concat(head, F.coalesce("text", F.lit("")))).alias("register"))


@query(BM25 + f", m as (select * from {ART} where doc_id in (select doc_id from labels)), t as (select doc_id, {URL} as source_url, text as t from documents) select bm.item_id as query, bm.rank::int as rank, coalesce(m.published_date, '') as date, coalesce({SUB}, '') as subtype, coalesce(split_part(slug, '-', 1), '') as drug_or_device, {REG} as register from bm join t using (doc_id) left join m on m.source_url = t.source_url where rank <= 5".replace("coalesce(case", "coalesce(case when slug is null then '' else case", 1).replace("'standalone' end, '')", "'standalone' end end, '')", 1))
def enrich_hits(spark, sf_dir):
    """Labelled documents have metadata."""
    known = _articles(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    meta = answers.article_metadata(known, "source_url", "slug", "published_date")
    return answers.enrich(_hits(spark, sf_dir, 5), meta).select("query", "rank", "date", "subtype", "drug_or_device", "register")


@query(BM25 + f", c as (select item_id, string_agg('[' || rank || '] source_url: ' || {URL} || chr(10) || x.text, chr(10) || chr(10) order by rank) as c from bm join documents x using (doc_id) where rank <= 3 group by item_id) select item_id as query, md5('CONTEXT PASSAGES:' || chr(10) || coalesce(c, '(no passages retrieved)') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || b.text || chr(10) || chr(10) || 'Answer using only the context above, following all the rules.') as prompt_md5 from benchmark b left join c using (item_id)")
def prompt_blocks(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return answers.prompts(q, answers.context(_hits(spark, sf_dir, 3))).select("query", F.md5("prompt").alias("prompt_md5"))


@query(BM25 + f" select item_id as query, array_to_string(list_sort(list_distinct(list({URL}))), ' ') as sources from bm join documents using (doc_id) where rank <= 5 group by item_id")
def distinct_sources(spark, sf_dir):
    return answers.sources(_hits(spark, sf_dir, 5)).withColumn("sources", F.array_join("sources", " "))


# --- training data


@query(MATCH + " select doc_id from documents where doc_id not in (select doc_id from hit)")
def leakage_exclusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return training.without_leaks(d, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text").select("doc_id")


NEG = RANKS + """,
pos as (select item_id, doc_id from bm where rank = 1), ne as (select item_id, doc_id, rank from bm where (item_id, doc_id) not in (select item_id, doc_id from pos) and doc_id not in (select doc_id from hit)),
ng as (select item_id, arg_min(doc_id, rank) as doc_id, min(rank) as rank from ne group by item_id)"""


def _pairs(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    lexical = retrieval.Lexical(docs, "doc_id", "text")
    pos = lexical.top(asked, "item_id", "text", 1).select("query", "item")
    banned = _matches(spark, sf_dir).select(F.col("doc_id").alias("item"))
    return pos, training.mined(lexical, asked, pos, banned, "item_id", "text")


@query(NEG + " select item_id as query, doc_id as item, rank::int as rank from ng")
def hard_negatives(spark, sf_dir):
    """The best hit stands for a question's positive; documents with a benchmark passage are banned."""
    return _pairs(spark, sf_dir)[1]


@query(NEG + " select item_id as query, doc_id as item, 1::int as label from pos union all select item_id, doc_id, 0::int from ng")
def train_pairs(spark, sf_dir):
    return training.pairs(*_pairs(spark, sf_dir))


@query("""with s as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as place, count(*) over () as n from labels)
select doc_id, case when place <= greatest(1, floor(n * 0.1)) then 'val' else 'train' end as part from s""")
def train_val_split(spark, sf_dir):
    return training.split(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "part")


@query("""with s as (select doc_id, row_number() over (order by md5('0:' || doc_id), doc_id) as place, quality + 1 as c from labels), t as (select *, coalesce(sum(c) over (order by place rows between unbounded preceding and 1 preceding), 0) as b from s)
select doc_id, place::int as place from t where b < 100""")
def seeded_until_target(spark, sf_dir):
    """Labels in seeded order until their counts (quality + 1) reach 100; the target is the feature."""
    rows = training.shuffled(table(spark, sf_dir, "labels"), "doc_id").withColumn("c", F.col("quality") + 1)
    return training.until_target(rows, "place", "c", 100).select("doc_id", "place")


# --- snapshots and checks


@query(f"select left(sha256(array_to_string(list_sort(list(slug)), chr(10))), 12) as snapshot_id, count(*) as n_articles, min(nullif(published_date, '')) as date_min, max(nullif(published_date, '')) as date_max from {ART}")
def snapshot_id(spark, sf_dir):
    return corpus.snapshot(_articles(spark, sf_dir), "slug", "published_date")


GOLD = """(select item_id::varchar as id, case when item_id % 11 = 0 then ' ' else text end as question, case item_id % 4 when 0 then 'HCP' when 1 then 'patient' when 2 then 'either' else 'other' end as register,
case when item_id % 5 = 0 then 'unanswerable' else 'single_passage' end as type, case when item_id % 6 = 5 then 'spoken' else 'verbatim' end as phrasing, item_id % 5 <> 0 as answerable, item_id % 9 <> 0 as has_passage, text from benchmark)"""


def _gold(spark, sf_dir):
    """Benchmark items as gold items, some of them broken on purpose."""
    k = F.col("item_id")
    passage = F.array(F.struct(F.concat(F.lit("u"), (k % 3).cast("string")).alias("source_url"), F.col("text").alias("passage_text")))
    return table(spark, sf_dir, "benchmark").select(
        k.cast("string").alias("id"),
        F.when(k % 11 == 0, " ").otherwise(F.col("text")).alias("question"),
        F.when(k % 4 == 0, "HCP").when(k % 4 == 1, "patient").when(k % 4 == 2, "either").otherwise("other").alias("register"),
        F.when(k % 5 == 0, "unanswerable").otherwise("single_passage").alias("type"),
        F.when(k % 6 == 5, "spoken").otherwise("verbatim").alias("phrasing"),
        (k % 5 != 0).alias("answerable"),
        F.when(k % 9 != 0, passage).otherwise(F.array().cast("array<struct<source_url:string,passage_text:string>>")).alias("supporting_passages"),
    )


@query(f"""select id, 'no question' as problem from {GOLD} where trim(question) = '' union all select id, 'register' from {GOLD} where register = 'other' union all select id, 'phrasing' from {GOLD} where phrasing = 'spoken'
union all select id, 'passages' from {GOLD} where answerable <> has_passage union all select id, 'empty passage field' from {GOLD} where has_passage and coalesce(trim(text), '') = ''""")
def gold_violations(spark, sf_dir):
    return corpus.gold_problems(_gold(spark, sf_dir))


@query("select item_id::varchar as id, 'unknown source' as problem from benchmark where item_id % 9 <> 0 and item_id % 3 = 2")
def referential_check(spark, sf_dir):
    """Sources u0 and u1 are known, u2 isn't."""
    known = spark.createDataFrame([("u0",), ("u1",)], "source_url string")
    return corpus.unknown_sources(_gold(spark, sf_dir), known)


@query(MATCH + f""", w as (select doc_id, {SPC.format("text")} as w from documents),
c as (select doc_id, unnest(range(0, {_n_windows("len(w)", SIZE, SIZE - OVER)})) as i, w from w), ch as (select array_to_string(w[i * {SIZE - OVER} + 1 : i * {SIZE - OVER} + {SIZE}], ' ') as x from c),
cn as (select nd, list_distinct(string_split(nd, ' ')) as s from (select {NORM.format("x")} as nd from ch)),
chit as (select distinct item_id from bt, cn where contains(nd, np) or len(list_filter(t, lambda x: list_contains(s, x))) >= 0.9 * len(t) - 1e-9)
select item_id, case when item_id in (select item_id from chit) then 'OK' when item_id in (select item_id from hit) then 'SPLIT' else 'MISSING' end as status from benchmark""")
def passage_status(spark, sf_dir):
    """Benchmark passages against all window chunks and all documents."""
    chunks = chunk_fixed_windows(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark")
    inside = evaluation.containment(b, chunks, "item_id", "text", "chunk_id", "text")
    return evaluation.passage_status(b, inside, _matches(spark, sf_dir), "item_id")


@query(f"""with a as (select *, split_part(slug, '-', 1) as topic from {ART} where not starts_with(slug, '{T.BULLETIN_PREFIX}') and not contains(slug, '{T.ROUNDUP_PART}')),
t as (select topic, count(*) as n_articles, arg_max(source_url, (published_date, source_url)) as newest from a group by topic having count(*) > 1)
select topic, n_articles, newest, newest in (select {URL} from documents where doc_id in (select doc_id from labels where quality = 1)) as newest_cited from t""")
def topic_currency(spark, sf_dir):
    """Documents labelled as good are cited."""
    a = _articles(spark, sf_dir)
    return evaluation.topic_currency(a, a.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi"), "source_url", "slug", "published_date")


@query(r"""
with b as (select doc_id, string_split('Intro' || chr(10) || case when doc_id % 2 = 0 then 'Advice for patients:' else 'Note' end || chr(10) || coalesce(text, '') || chr(10) || 'Report side effects' || chr(10) || 'end', chr(10)) as l from documents),
f as (select doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(lower(trim(x)), 'to give to patients|advice for patients|patients or parents|patients and caregiver')), true) as f from b),
r as (select doc_id, case when f > 0 then l[f + 1 :] else [] end as r from f),
s as (select doc_id, r, list_position(list_transform(r, lambda x: contains(lower(trim(x)), 'advice for healthcare professional') or starts_with(lower(trim(x)), 'report ') or (contains(lower(trim(x)), 'yellow card') and length(x) < 70)), true) as s from r)
select doc_id, left(array_to_string(list_filter(list_transform(case when s > 0 then r[1 : s - 1] else r end, lambda x: trim(x)), lambda x: x <> '')[1:3], ' '), 400) as passage from s""")
def probe_passage(spark, sf_dir):
    """Documents between a heading (for patients where the id is even) and a closing line."""
    head = F.when(F.col("doc_id") % 2 == 0, "Advice for patients:").otherwise("Note")
    body = F.concat(F.lit("Intro\n"), head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nReport side effects\nend"))
    return evaluation.patient_passage(table(spark, sf_dir, "documents").withColumn("body", body), "doc_id", "body")


@query("""
with e as (select event_id, case event_id % 4 when 0 then 'x {"faithful": true, "label": "correct", "verdict": "pass"} y' when 1 then '{"faithful": "true", "label": "maybe", "verdict": "FAIL"}' when 2 then 'no json' else props end as raw from events)
select event_id, event_id % 4 = 0 as faithful, case when event_id % 4 = 0 then 'correct' else 'wrong' end as label, event_id % 4 = 0 as passed, coalesce((case when event_id % 4 = 3 then json_extract_string(raw, '$.k') end)::bigint, -1) as k from e""")
def json_verdict(spark, sf_dir):
    """Verdict texts, good and broken, and the events' own JSON."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, 'x {"faithful": true, "label": "correct", "verdict": "pass"} y').when(k == 1, '{"faithful": "true", "label": "maybe", "verdict": "FAIL"}').when(k == 2, "no json").otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    own = F.coalesce(F.from_json(answers.json_part("raw"), "k bigint")["k"], F.lit(-1))
    return e.select("event_id", answers.faithful("raw").alias("faithful"), answers.correctness("raw").alias("label"), answers.passed("raw").alias("passed"), own.cast("long").alias("k"))


from . import catalogue_pipeline, catalogue_more  # noqa: E402,F401  (they add their queries)
