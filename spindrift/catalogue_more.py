"""Queries through data sources, stored indexes, joins in time and grouping sets; ``catalogue`` adds them to its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables
from .catalogue import BEST, BM25, DENSE, GOLD, IDF_SQL, RANKS, _bm25, _gold, _ranks, idf_sql, query, table
from .catalogue_pipeline import BODY_SQL, _entities
from .functions import sections
from .functions import text as T
from .operators import clusters, evaluation, fitting, postings, ranks, spans
from .functions import text as T
from .plans import config, pipeline
from .sources import corpus, search
from .streaming import increment

# --- the search source

_DAY = "'2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((page_id % 28 + 1)::varchar, 2, '0')"


def _results(spark, sf_dir):
    """Pages as search results: the language in their address as type, a date made of the id."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat(F.lit("2024-"), two(F.col("page_id") % 12 + 1), F.lit("-"), two(F.col("page_id") % 28 + 1))
    kind = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    return table(spark, sf_dir, "pages").where("url is not null").select(kind.alias("document_type"), day.alias("published_date"), F.concat(day, F.lit("T00:00:00Z")).alias("public_timestamp"), F.col("url").alias("link"), F.col("page_id").cast("string").alias("title"))


_PAGES = f"r as (select regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as document_type, {_DAY} as published_date, url as link, page_id::varchar as title from pages where url is not null)"


@query(f"with {_PAGES} select document_type, published_date, link, title from r where document_type in ('de', 'en') and published_date >= '2024-03-05' and published_date < '2024-11-01' and link like 'https://%'")
def search_source(spark, sf_dir):
    """Results stored by month and read back through the data source, which applies all four filters itself."""
    search.register(spark)
    at = search.store(_results(spark, sf_dir), tables.place(spark, "results"))
    rows = spark.read.format(search.NAME).option("path", at).load()
    rows = rows.where(F.col("document_type").isin("de", "en") & (F.col("published_date") >= "2024-03-05") & (F.col("published_date") < "2024-11-01") & F.col("link").startswith("https://"))
    return rows.select("document_type", "published_date", "link", "title")


@query(f"with {_PAGES} select document_type, published_date, link, title from r where document_type = 'en' and published_date >= '2024-02-01' order by published_date, link limit 50")
def search_source_oldest(spark, sf_dir):
    """The source's own count: the fifty oldest results of a type, of which each task hands over fifty at most."""
    search.register(spark)
    at = search.store(_results(spark, sf_dir), tables.place(spark, "results"))
    return search.oldest(spark, (F.col("document_type") == "en") & (F.col("published_date") >= "2024-02-01"), 50, path=at).select("document_type", "published_date", "link", "title")


# --- a stored index

#: Bytes of text in a file of changes.
FEED = 32 << 20


def _stored(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return postings.Postings.build(postings.token_counts(d, "doc_id", "text"), postings.lengths(d, "doc_id", "text"), tables.place(spark, "postings"))


@query(BM25 + f" select item_id, doc_id, round(score, 6) as score, rank::int as rank from bm where rank <= {BEST}")
def bm25_stored(spark, sf_dir):
    """Every benchmark text against all documents, through an index in a folder: no text is read at search."""
    hits = _stored(spark, sf_dir).top(table(spark, sf_dir, "benchmark"), "item_id", "text", BEST)
    return hits.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("with " + IDF_SQL + " select term, df, round(idf, 7) as idf from idf")
def stored_terms(spark, sf_dir):
    """The index's vocabulary."""
    return _stored(spark, sf_dir).idf.withColumn("idf", F.round("idf", 7)).withColumn("df", F.col("df").cast("long"))


@query("with " + idf_sql("documents where doc_id % 10 <> 7") + " select term, df, round(idf, 7) as idf from idf")
def incremental_terms(spark, sf_dir):
    """Documents as a stream of changes in any order: each begins with another text, which is replaced, and a tenth is deleted."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", "lang")
    rows = d.select("item", F.lit(1).cast("long").alias("seq"), F.concat_ws(" ", "lang", F.left("text", F.lit(40))).alias("text"), F.lit(False).alias("gone"))
    rows = rows.unionByName(d.select("item", F.lit(2).cast("long").alias("seq"), "text", F.lit(False).alias("gone")))
    rows = rows.unionByName(d.where("item % 10 = 7").select("item", F.lit(3).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("gone")))
    feed, inc = tables.place(spark, "feed"), increment.Increment(spark, tables.place(spark, "increment"))
    # three batches, each of as many files as its bytes need
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = -(-size // (3 * FEED)) or 1
    rows.repartition(3 * each, F.xxhash64("item", "seq")).write.parquet(feed)
    stream = spark.readStream.schema(increment.CHANGE).option("maxFilesPerTrigger", each).parquet(feed)
    inc.follow(stream, tables.place(spark, "progress")).awaitTermination()
    return inc.idf().withColumn("idf", F.round("idf", 7))


# --- joins in time, percentiles, grouping sets


def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""with v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by all),
q as (select event_id, user_id, ts from events where event_type = 'purchase')
select q.event_id, v.event_id as version, v.ts as since from q asof left join v on q.user_id = v.user_id and q.ts >= v.ts""")
def asof_version(spark, sf_dir):
    """A user's purchases cite what the user has viewed last: the version that is current at the purchase, if any."""
    got = spans.as_of(_events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), _events(spark, sf_dir, "view").select("event_id", "user_id", "ts"), ["user_id"], "ts", "ts", "event_id")
    return got.select("event_id", F.col("found.event_id").alias("version"), F.col("found.ts").alias("since"))


@query("""with p as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + (value * 60)::int as e from events where value is not null)
select a.event_id as click, b.event_id as error from p a join p b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'error' and a.s < a.e and b.s < b.e and a.s < b.e and b.s < a.e""")
def overlapping_periods(spark, sf_dir):
    """Clicks and errors of a user whose periods (as many minutes as their value says) overlap."""
    began = F.unix_seconds(F.col("ts").cast("timestamp"))
    p = lambda kind: _events(spark, sf_dir, kind).where("value is not null").select("event_id", "user_id", began.alias("s"), (began + F.bround(F.col("value") * 60, 0).cast("int")).alias("e"))
    got = spans.overlaps(p("click"), p("error"), ["user_id"], "s", "e")
    return got.select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("error"))


@query("select l_returnflag, l_linestatus, count(*) as n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) as p{int(p * 100)}" for p in (0.05, 0.5, 0.99)) + " from lineitem where l_extendedprice is not null group by all")
def price_percentiles(spark, sf_dir):
    """Exact percentiles of a few groups that each hold much of the table."""
    got = ranks.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p99": 0.99})
    return got.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("p5", "p50", "p99")])


@query(RANKS + f""", it as (select item_id::varchar as id, r from rr), gg as (select register, type, phrasing, r from it join {GOLD} using (id))
select register, type, phrasing, grouping(register, type, phrasing)::bigint as level, count(*) as n, {", ".join(f"count(*) filter (where r <= {k}) as recall_at_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::double / r, 0)), 4) as mrr from gg group by cube (register, type, phrasing)""")
def metrics_by_kind(spark, sf_dir):
    """recall@k and MRR of BM25 by register, type and phrasing of the gold items, with all their totals."""
    items = _gold(spark, sf_dir).select(F.col("id").cast("long").alias("query"), "register", "type", "phrasing")
    return evaluation.grouped_metrics(items.join(_ranks(spark, sf_dir), "query"), "first_relevant_rank", ["register", "type", "phrasing"])


@query(DENSE + " select query, item, round(score, 7) as score, rank::int as rank from de where rank <= 10")
def dense_pruned(spark, sf_dir):
    """Vectors of ids divisible by 20 against all, through clusters that are skipped where their bound is too low."""
    e = table(spark, sf_dir, "embeddings")
    index = clusters.Clusters.build(e, "vec_id", "embedding", tables.place(spark, "clusters"))
    return index.top(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 7))


# --- sections and the fitted scorer

_PARTED = "regexp_replace(replace(html, '</p>', '<h2>More</h2>'), '<p>|<b>', '', 'g')"
_NODES = "list_filter(list_transform(regexp_split_to_array({}, '<!--[^>]*-->|<[^>]*>'), lambda x: " + _entities(r"regexp_replace(x, '^\s+|\s+$', '', 'g')") + "), lambda x: x <> '')"


@query(rf"""with a as (select page_id, string_split(regexp_extract({_PARTED}, '(?s)<article>(.*?)</article>', 1), '<h2>') as s from pages where html is not null),
p as (select page_id, unnest(range(0, len(s))) as i, unnest(s) as x from a),
t as (select page_id, i, {_NODES.format("x")} as n, array_to_string({_NODES.format("regexp_extract(x, '(?s)<h1>(.*?)</h1>', 1)")}, '') as title from p)
select page_id, i::int as section, case when i = 0 then title else n[1] end as heading, md5(case when i = 0 then title || chr(10) else '' end || array_to_string(n, chr(10))) as text_md5 from t where len(n) > 0""")
def page_sections(spark, sf_dir):
    """Pages with a heading at each paragraph's end, one row a section, by the table function in SQL."""
    sections.register(spark, "sections")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.replace("html", F.lit("</p>"), F.lit("<h2>More</h2>")), "<p>|<b>", "").alias("html"))
    return spark.sql("select p.page_id, s.section, s.heading, md5(s.text) as text_md5 from {p} p, lateral sections(p.html, 'article') s", p=p)


@query()
def fitted_scorer(spark, sf_dir):
    """A pair scorer fitted over the cluster on each benchmark text's best documents (the first is the answer, the others aren't), written, loaded, and the documents reranked by it."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = tables.cut(_bm25(spark, sf_dir, 5).join(b.select(F.col("item_id").alias("query"), F.col("text").alias("q")), "query").join(d.select(F.col("doc_id").alias("item"), F.col("text").alias("t")), "item"), "hits")
    rows = hits.withColumn("label", (F.col("rank") == 1).cast("int"))
    val = F.pmod(F.crc32(F.col("query").cast("string").cast("binary")), F.lit(5)) == 0
    best, _ = fitting.fit(rows.where(~val), rows.where(val), "q", "t", steps=20)
    scorer = fitting.Scorer.load(spark, best.write(spark, tables.place(spark, "scorer")))
    return hits.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), F.col("rank").alias("base_rank"), F.round(scorer.score("q", "t"), 6).alias("score"))


# --- articles from results and pages

_STAMP = "'2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-01T00:00:00'"


@query(f"""with r as (select url, {_STAMP} as stamp, page_id from pages union all select url, {_STAMP} || 'Z', page_id + 1000000 from pages where page_id % 50 = 0),
m as (select url, split_part(url, '/', -1) as slug, left(stamp, 10) as published_date, 'p' || page_id as title from r where starts_with(url, 'http') and left(stamp, 10) between '2024-03-01' and '2024-10-31'),
raw as (select split_part(url, '/', -1) as slug, min(html collate "C") as html from pages group by 1),
b as (select m.*, {BODY_SQL} as t, trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) as h1 from m join raw using (slug)),
x as (select *, array_to_string(t, chr(10)) as body from b)
select url as source_url, slug, published_date, case when h1 = '' then title else 'page' end as title, md5(body) as body_md5 from x
where trim(body) <> '' and len(list_filter([{", ".join(f"'{m}'" for m in T.BOILERPLATE)}], lambda k: contains(lower(body), k))) = 0""")
def articles_of_results(spark, sf_dir):
    """Articles of pages found by search, some of them twice: each result gives one article at most."""
    p = table(spark, sf_dir, "pages")
    stamp = F.concat(F.lit("2024-"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-01T00:00:00"))
    results = p.select(F.col("url").alias("link"), stamp.alias("public_timestamp"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("title"))
    again = p.where("page_id % 50 = 0").select(F.col("url").alias("link"), F.concat(stamp, F.lit("Z")).alias("public_timestamp"), F.concat(F.lit("p"), (F.col("page_id") + 1000000).cast("string")).alias("title"))
    cfg = config.Config(corpus=config.Corpus(link_prefix="http", published_after="2024-03-01", published_before="2024-10-31", max_articles=2**31 - 1))
    good, _ = pipeline.articles(cfg, results.unionByName(again), p.select(T.last_segment("url").alias("slug"), "html"), strict=False, body=("article",))
    own = F.when(F.col("title").rlike("^p[0-9]+$"), F.col("title")).otherwise("page")
    return good.select("source_url", "slug", "published_date", own.alias("title"), F.md5("body_text").alias("body_md5"))


_ODD = f"case page_id % 4 when 0 then '<article> </article>' when 1 then '<p>bare</p>' when 2 then '<article><p>Some {T.BOILERPLATE[0]} text</p></article>' else html end"


@query(f"""with h as (select page_id, {_ODD} as html, page_id % 10 = 9 as lost from pages where html is not null),
b as (select page_id, lost, contains(html, '<article>') as has, array_to_string({BODY_SQL}, chr(10)) as body from h)
select page_id::varchar as slug, case when lost then 'no page' when not has then 'no body container' when trim(body) = '' then 'empty body' else 'boilerplate' end as problem from b
where lost or not has or trim(body) = '' or len(list_filter([{", ".join(f"'{m}'" for m in T.BOILERPLATE)}], lambda k: contains(lower(body), k))) > 0""")
def rejected_pages(spark, sf_dir):
    """Pages of which three in four were spoilt and a tenth lost: why each one is refused."""
    p = table(spark, sf_dir, "pages").where("html is not null").withColumn("slug", F.col("page_id").cast("string"))
    k = F.col("page_id") % 4
    odd = F.when(k == 0, "<article> </article>").when(k == 1, "<p>bare</p>").when(k == 2, f"<article><p>Some {T.BOILERPLATE[0]} text</p></article>").otherwise(F.col("html"))
    raw = p.where("page_id % 10 <> 9").select("slug", odd.alias("html"))
    m = p.select("url", "slug", F.lit("t").alias("title"), F.lit("2024-01-01").alias("published_date"))
    return corpus.clean(m, raw, strict=False, body=("article",))[1].select("slug", "problem")


@query(r"select page_id, case when page_id % 2 = 0 then 'Lead of ' || page_id else '' end as summary, case when page_id % 3 = 0 then '' else 'Head ' || page_id end as title from pages where html is not null")
def page_summary(spark, sf_dir):
    """Pages behind a heading and a lead paragraph of their own, which some lack: what the parser takes as title and summary."""
    n = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 3 == 0, "<h1></h1>").otherwise(F.concat(F.lit("<h1>Head "), n, F.lit("</h1>")))
    lead = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<p class="a gem-c-lead-paragraph">Lead of '), n, F.lit('</p><p class="gem-c-lead-paragraph">second</p>'))).otherwise("")
    p = table(spark, sf_dir, "pages").where("html is not null").withColumn("html", F.concat(head, lead, "html"))
    return corpus.extract(p, "html", body=("article",)).select("page_id", "article.summary", "article.title")
