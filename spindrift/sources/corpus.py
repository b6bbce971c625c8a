"""Manifests, pages, articles, gold items and snapshots: reading, cleaning, checking, writing."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MANIFEST = "url string, slug string, title string, published_date string"
ARTICLE = "source_url string, slug string, title string, summary string, body_text string, published_date string"
CHUNK = "chunk_id string, source_url string, text string, parent_id string"
GOLD = "id string, question string, answer_key string, register string, type string, phrasing string, answerable boolean, supporting_passages array<struct<source_url:string,passage_text:string>>"
SNAPSHOT = "snapshot_id string, n_articles long, date_min string, date_max string"
PARENT = "parent_id string, source_url string, text string"
PAIR = "query string, item string, label int"
SCHEMAS = {"manifest": MANIFEST, "articles": ARTICLE, "chunks": CHUNK, "parents": PARENT, "gold": GOLD, "snapshot": SNAPSHOT, "pairs": PAIR}
# Selectors of the published pages, and block tags.
#: Containers of an article's body, the first that a page has wins: (attribute, value) or a tag.
BODY = (("data-module", "govspeak"), ("class", "govuk-govspeak"), "article")
LEAD = ("class", "gem-c-lead-paragraph")
BLOCKS = ("h2", "h3", "h4", "p", "ul", "ol", "li", "table", "div")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a kind of SCHEMAS; blank lines are skipped, absent fields are null."""
    return spark.read.schema(SCHEMAS[kind]).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def search(spark: SparkSession, api: str, kind: str, after: str, before: str, most: int, get=None) -> DataFrame:
    """Results (link, public_timestamp, title) of a search API, which filters, orders and counts itself. ``get`` reads a URL's JSON."""
    from urllib.parse import urlencode

    asked = {"filter_content_store_document_type": kind, "filter_public_timestamp": f"from:{after},to:{before}", "order": "public_timestamp", "count": str(most), "fields": "title,link,public_timestamp"}
    found = (get or _json)(f"{api}?{urlencode(asked)}").get("results", [])
    return spark.createDataFrame([(r.get("link", ""), r.get("public_timestamp", ""), (r.get("title") or "").strip()) for r in found], "link string, public_timestamp string, title string")


def _json(url: str) -> dict:
    import json
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as f:
        return json.load(f)


def select_links(results: DataFrame, link: str, stamp: str, prefix: str, after: str, before: str, most: int, base: str = "", title: str | None = None) -> DataFrame:
    """Search results to manifest rows: links below a path, stamped within [after, before], oldest first, at most ``most``. A row stays a row, with its own title where the results have one."""
    day = F.left(F.col(stamp), F.lit(10))
    rows = results.where(F.col(link).startswith(prefix) & (day >= after) & (day <= before))
    return rows.select(F.concat(F.lit(base), link).alias("url"), T.last_segment(link).alias("slug"), *([F.trim(title).alias("title")] if title else []), day.alias("published_date")).orderBy("published_date", "url").limit(most)


def to_fetch(manifest: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Manifest rows whose page isn't cached yet (cached: file names), or all of them, with the file's name."""
    named = manifest.withColumn("name", T.raw_name("slug"))
    return named if force else named.join(cached.select("name"), "name", "left_anti")


def fetch_all(manifest: DataFrame, cached: DataFrame, get, force: bool = False, pause: float = 1.0, workers: int = 1) -> DataFrame:
    """(name, slug, html) of the pages still to fetch, by ``get(url)``; each of ``workers`` tasks waits ``pause`` seconds between pages."""
    src = to_fetch(manifest, cached, force).select("name", "slug", "url").repartition(workers)

    def run(batches):
        import time

        first = True
        for pdf in batches:
            html = []
            for url in pdf["url"]:
                if not first:
                    time.sleep(pause)
                first = False
                html.append(get(url))
            yield pdf[["name", "slug"]].assign(html=html)

    return src.mapInPandas(run, "name string, slug string, html string")


def missing_pages(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """Slugs of the manifest that have no page."""
    return manifest.join(raw.where("html is not null").select("slug"), "slug", "left_anti").select("slug").distinct()


def require_pages(manifest: DataFrame, raw: DataFrame) -> None:
    """Raise where an article has no page: it would vanish from the corpus unseen."""
    if some := [r.slug for r in missing_pages(manifest, raw).orderBy("slug").limit(5).collect()]:
        raise FileNotFoundError(f"articles without a page, the first: {', '.join(some)}")


class _Page(HTMLParser):
    """Reads a page once; keeps h1, lead paragraph, body text nodes and the top-level sections of the body."""

    def __init__(self, body):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.found = body, [], {}
        self.h1 = self.lead = None
        self.events: dict = {}

    def _is(self, rule, tag, attrs) -> bool:
        if isinstance(rule, str):
            return tag == rule
        value = dict(attrs).get(rule[0]) or ""
        return rule[1] in value.split() if rule[0] == "class" else value == rule[1]

    def handle_starttag(self, tag, attrs):
        marks = []
        if tag == "h1" and self.h1 is None:
            self.h1 = []
            marks.append("h1")
        if self.lead is None and self._is(LEAD, tag, attrs):
            self.lead = []
            marks.append("lead")
        for k, rule in enumerate(self.wanted):
            if k not in self.events and self._is(rule, tag, attrs):
                self.events[k] = []
                marks.append(k)
        for k, e in self.events.items():
            if k not in marks and any(k in m for _, m in self.stack):
                e.append(("<", tag))
        if tag not in _VOID:
            self.stack.append((tag, marks))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, marks = self.stack.pop()
            for k, e in self.events.items():
                if k not in marks and any(k in m for _, m in self.stack):
                    e.append((">", t))
            if t == tag:
                break

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        for _, marks in self.stack:
            for m in marks:
                if m == "h1":
                    self.h1.append(text)
                elif m == "lead":
                    self.lead.append(text)
                else:
                    self.events[m].append(("t", text))


def parse_page(html: str | None, body=BODY) -> dict:
    """title, summary, body (None where no container is found), and the sections that top-level h2 elements begin."""
    p = _Page(body)
    p.feed(html or "")
    p.close()
    out = {"title": "".join(p.h1 or []), "summary": "".join(p.lead or []), "body": None, "sections": [], "has_h1": p.h1 is not None, "has_lead": p.lead is not None}
    if not p.events:
        return out
    events = p.events[min(p.events)]
    out["body"] = "\n".join(x for k, x in events if k == "t")
    # wrappers: while the container has one child element and no heading of its own, go down
    depth, kids, level = 0, {}, 0
    for k, x in events:
        if k == "<":
            kids.setdefault(depth, []).append(x)
            depth += x not in _VOID
        elif k == ">":
            depth -= 1
    while kids.get(level) and len(kids[level]) == 1 and kids[level][0] in ("div", "article", "section"):
        level += 1
    sections, depth = [[]], 0
    for k, x in events:
        if k == "<":
            if x == "h2" and depth == level:
                sections.append([])
            depth += x not in _VOID
        elif k == ">":
            depth -= 1
        else:
            sections[-1].append(x)
    head = [x for x in (out["title"], out["summary"]) if x]
    first = head + sections[0]
    rest = ["\n".join(s) for s in sections[1:] if s]
    out["sections"] = (["\n".join(first)] if first else []) + rest if len(sections) > 1 else ["\n".join(first)] if first else []
    return out


def extract(pages: DataFrame, html: str, body=BODY) -> DataFrame:
    """Pages with a struct ``article`` (title, summary, body, sections); an Arrow UDF, as no built-in reads HTML."""
    from .. import ship

    ship(pages.sparkSession)

    @F.pandas_udf("title string, summary string, body string, sections array<string>, has_h1 boolean, has_lead boolean")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x, body) for x in s], columns=["title", "summary", "body", "sections", "has_h1", "has_lead"])

    return pages.withColumn("article", f(html))


def clean(manifest: DataFrame, raw: DataFrame, strict: bool = True, body=BODY) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected): manifest joined with raw (slug, html); missing pages, page chrome and empty bodies refused. A row of the manifest gives one article at most: of several pages of a slug the least text counts.

    ``strict`` makes the articles fail on the first refused page when they are
    read; else such pages are only left to ``rejected``.
    """
    x = extract(manifest.join(raw.groupBy("slug").agg(F.min("html").alias("html")), "slug", "left"), "html", body)
    why = F.when(F.col("html").isNull(), "no page").when(F.col("article.body").isNull(), "no body container").when(F.trim("article.body") == "", "empty body").when(F.size(T.boilerplate_found("article.body")) > 0, "boilerplate")
    x = x.withColumn("problem", why)
    title = F.coalesce(F.nullif("article.title", F.lit("")), F.col("title"))
    rows = x.select(F.col("url").alias("source_url"), "slug", title.alias("title"), F.col("article.summary").alias("summary"), F.col("article.body").alias("body_text"), "published_date", F.col("article.sections").alias("sections"), "problem")
    bad = rows.where("problem is not null").select("source_url", "slug", "problem")
    if strict:
        rows = rows.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("slug", F.lit(": "), "problem"))))
    return rows.where("problem is null").drop("problem"), bad


def title_of(html):
    """Text of the first h1 by pattern, entities kept; stays inside the JVM."""
    raw = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(raw, "<[^>]*>", ""))


def skeleton(html):
    """Sorted distinct block tags of a page."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(html), F.lit(""))), F.lit(rf"<({'|'.join(BLOCKS)})[\s>/]"), F.lit(1))))


def same_structure(pages: DataFrame, order: str, html: str) -> DataFrame:
    """One row: whether the first and last page by ``order`` agree in having h1, lead and body; the tag profiles are shown beside."""
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    s = F.struct(F.regexp_like(low, F.lit(r"<h1[\s>]")).alias("has_h1"), F.contains(low, F.lit("gem-c-lead-paragraph")).alias("has_lead"), F.regexp_like(low, F.lit(r"<article[\s>]|govspeak")).alias("has_body"))
    rows = pages.select(F.col(order).alias("k"), s.alias("s"), skeleton(html).alias("tags"))
    two = rows.agg(F.min_by(F.struct("s", "tags"), "k").alias("a"), F.max_by(F.struct("s", "tags"), "k").alias("b"))
    return two.select((F.col("a.s") == F.col("b.s")).alias("same"), F.array_join("a.tags", ",").alias("oldest_tags"), F.array_join("b.tags", ",").alias("newest_tags"))


def snapshot(articles: DataFrame, slug: str, date: str) -> DataFrame:
    """One row: id (12 hex of sha256 over the sorted slugs), number, least and greatest date.

    The hash needs every slug in one row: a corpus' article list, not its texts.
    """
    d = F.nullif(F.coalesce(F.col(date), F.lit("")), F.lit(""))
    return articles.agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(slug)), "\n"), 256), F.lit(12)).alias("snapshot_id"), F.count("*").alias("n_articles"), F.min(d).alias("date_min"), F.max(d).alias("date_max"))


def write_snapshot(snap: DataFrame, path: str) -> None:
    snap.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["snapshot"]).json(path)


def answerable(gold: DataFrame) -> DataFrame:
    return gold.where("answerable")


def unanswerable(gold: DataFrame) -> DataFrame:
    return gold.where("not answerable")


def gold_problems(gold: DataFrame) -> DataFrame:
    """(id, problem) for every broken rule of a gold item, repeated ids included."""
    p = F.col("supporting_passages")
    n = F.coalesce(F.size(p), F.lit(0))
    rules = [
        (F.coalesce(F.trim("id") == "", F.lit(True)), "no id"),
        (F.coalesce(F.trim("question") == "", F.lit(True)), "no question"),
        (~F.coalesce(F.col("register").isin("HCP", "patient", "either"), F.lit(False)), "register"),
        (~F.coalesce(F.col("type").isin("single_passage", "multi_passage", "unanswerable"), F.lit(False)), "type"),
        (~F.coalesce(F.col("phrasing").isin("verbatim", "paraphrased"), F.lit(False)), "phrasing"),
        (F.col("answerable").isNull(), "answerable"),
        (F.col("answerable") & (F.col("type") == "unanswerable") | ~F.col("answerable") & (F.col("type") != "unanswerable"), "answerable against type"),
        (F.col("answerable") & (n == 0) | ~F.col("answerable") & (n > 0), "passages"),
        (F.exists(p, lambda x: F.coalesce(F.trim(x["source_url"]) == "", F.lit(True)) | F.coalesce(F.trim(x["passage_text"]) == "", F.lit(True))), "empty passage field"),
    ]
    each = gold.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())).alias("problem"))
    twice = gold.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return each.unionByName(twice)


def load_gold(spark: SparkSession, path: str, known_urls: DataFrame | None = None) -> DataFrame:
    """Gold items; raises on broken rules or passages from articles that aren't known."""
    gold = read_lines(spark, path, "gold")
    bad = gold_problems(gold)
    if known_urls is not None:
        bad = bad.unionByName(unknown_sources(gold, known_urls))
    if some := bad.limit(20).collect():
        raise ValueError("; ".join(f"{r.id}: {r.problem}" for r in some))
    return gold


def unknown_sources(gold: DataFrame, known_urls: DataFrame) -> DataFrame:
    urls = gold.select("id", F.explode("supporting_passages").alias("p")).select("id", F.col("p.source_url").alias("source_url"))
    return urls.join(known_urls.select("source_url"), "source_url", "left_anti").select("id", F.lit("unknown source").alias("problem"))


def gold_stamp(version: str, snap: DataFrame | None) -> str:
    """The gold set's version and the corpus it belongs to, unknown where no snapshot can be read."""
    from pyspark.errors import PySparkException

    try:
        row = snap.first() if snap is not None else None
    except PySparkException:
        row = None
    return f"{version}+corpus:{row.snapshot_id if row else 'unknown'}"
