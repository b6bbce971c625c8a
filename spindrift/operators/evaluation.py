"""Passage matching, relevance ranks, retrieval and answer metrics, certification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import cut
from .ranks import at_ranks
from .scans import running

#: Share of a passage's tokens that a text must hold.
OVERLAP = 0.9

# What begins and ends the patients' part of an article.
PATIENT_HEADING = "to give to patients|advice for patients|patients or parents|patients and caregiver"
STOP_PART, STOP_START, STOP_SHORT = "advice for healthcare professional", "report ", "yellow card"
#: What is stripped from its lines: all of Unicode's space separators, as SQL's trim does; F.trim alone strips U+0020.
SPACES = " \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"


def containment(passages: DataFrame, texts: DataFrame, passage_id: str, passage: str, text_id: str, text: str, share: float = OVERLAP, entities: bool = False) -> DataFrame:
    """Distinct (passage_id, text_id) where a normalised passage is part of a text or ``share`` of its tokens are among the text's.

    No pair is compared without evidence: a pair that matches shares one of the
    passage's n - ceil(share n) + 1 rarest tokens or, as a part, its rarest
    inner token, so texts meet passages on those tokens and only such pairs are
    checked in full. Passages of one or two tokens have no inner token: one
    token must be part of a token of the text, the first of two must end one, so
    they meet the vocabulary's parts and ends by equality. Empty passages match
    nothing.
    """
    p = passages.select(F.col(passage_id).alias("pid"), T.normalize(passage, entities).alias("np")).where("np <> ''").withColumn("pt", F.split("np", " "))
    # normalised once: the texts are read three times
    t = cut(texts.select(F.col(text_id).alias("tid"), T.normalize(text, entities).alias("nt")).where("nt is not null"), "texts")
    spots = p.select("pid", F.size("pt").alias("n"), F.posexplode("pt").alias("at", "token"))
    seen = t.select("tid", F.explode(F.array_distinct(F.split("nt", " "))).alias("token")).join(spots.select("token").distinct(), "token", "left_semi")
    df = seen.groupBy("token").agg(F.count("*").alias("df"))
    known = spots.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    inner = (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)
    w, v = Window.partitionBy("pid").orderBy("df", "token", "at"), Window.partitionBy("pid", "inner").orderBy("df", "token", "at")
    known = known.withColumn("inner", inner).withColumn("r", F.row_number().over(w)).withColumn("ri", F.row_number().over(v))
    keys = known.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1) | (F.col("inner") & (F.col("ri") == 1))).select("pid", "token").distinct()
    pairs = keys.join(seen, "token").select("pid", "tid")
    if short := [r.n for r in p.where(F.size("pt") < 3).select(F.length(F.element_at("pt", 1)).alias("n")).distinct().collect()]:  # lengths of words
        pairs = pairs.unionByName(_short(p, t, sorted(short)))
    whole = F.contains("nt", "np")
    part = T.let(F.array_except("pt", F.split("nt", " ")), lambda lost: F.size(F.filter(F.col("pt"), lambda x: ~F.array_contains(lost, x)))) >= share * F.size("pt") - 1e-9
    checked = pairs.distinct().join(t, "tid").join(p, "pid").where(whole | part).select("pid", "tid")
    return checked.distinct().select(F.col("pid").alias(passage_id), F.col("tid").alias(text_id))


def _short(p: DataFrame, t: DataFrame, lengths: list[int]) -> DataFrame:
    """(pid, tid) where a text may hold a passage of one or two tokens; ``lengths`` are those of their first tokens."""
    held = t.select("tid", F.explode(F.array_distinct(F.split("nt", " "))).alias("token"))
    n, size = F.length("token"), F.array(*[F.lit(x) for x in lengths])
    words = held.select("token").distinct()
    fits = F.filter(size, lambda k: k <= n)
    inside = words.select("token", F.explode(F.array_distinct(F.flatten(F.transform(fits, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("token", i, k)))))).alias("first"))
    ends = words.select("token", F.explode(F.transform(fits, lambda k: F.right("token", k))).alias("first"))
    first = p.select("pid", F.size("pt").alias("k"), F.element_at("pt", 1).alias("first"))
    met = inside.join(first.where("k = 1"), "first").unionByName(ends.join(first.where("k = 2"), "first")).select("pid", "token")
    return met.join(held, "token").select("pid", "tid")


def any_of(matches: DataFrame, passages: DataFrame, key: str, passage_id: str, text_id: str) -> DataFrame:
    """Distinct (key, text_id) where a text holds any of the key's passages: matches (passage_id, text_id), passages (key, passage_id)."""
    return matches.join(passages.select(key, passage_id), passage_id).select(key, text_id).distinct()


def limited(gold: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n answerable items and the first max(1, n // 4) unanswerable ones."""
    ask, rest = gold.where("answerable").orderBy(order).limit(n), gold.where("not answerable").orderBy(order).limit(max(1, n // 4))
    return ask.unionByName(rest)


def end_to_end(retrieval: DataFrame, generation: DataFrame, name: str) -> DataFrame:
    """Sums of the medians of each named retrieval and generation summary."""
    a, b = retrieval.select(F.col(name).alias("retrieval"), F.col("median_s").alias("_x")), generation.select(F.col(name).alias("generation"), F.col("median_s").alias("_y"))
    return a.crossJoin(F.broadcast(b)).select("retrieval", "generation", F.round(F.col("_x") + F.col("_y"), 2).alias("end_to_end_s"))


def chunk_averages(articles: DataFrame, chunks: DataFrame, article: str, parent: str | None = None) -> DataFrame:
    """One row: chunks, articles and chunks an article to one decimal, and children a parent where ``parent`` is given; 0 where there are none."""
    n = articles.agg(F.count("*").alias("n_articles"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(parent or article).alias("_p"))
    per = lambda d: F.when(F.col(d) > 0, F.round(F.col("n_chunks") / F.col(d), 1)).otherwise(F.lit(0.0))
    more = [F.col("_p").alias("n_parents"), per("_p").alias("children_per_parent")] if parent else []
    return c.crossJoin(F.broadcast(n)).select("n_chunks", "n_articles", per("n_articles").alias("chunks_per_article"), *more)


def first_relevant(hits: DataFrame, matches: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, first_relevant_rank) for every query, null where no hit (query, item, rank) is among the matches (query, item)."""
    best = hits.join(matches.select("query", "item").distinct(), ["query", "item"], "left_semi").groupBy("query").agg(F.min("rank").alias("first_relevant_rank"))
    return queries.select("query").join(best, "query", "left")


def retrieval_metrics(ranks: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """One row: n, hits at each k, the sum of reciprocal ranks over all n (0 where n is 0)."""
    r = F.col("first_relevant_rank")
    out = ranks.agg(F.count("*").alias("n"), *[F.count_if(r <= k).alias(f"recall_at_{k}") for k in ks], F.coalesce(F.sum(F.coalesce(1.0 / r, F.lit(0.0))), F.lit(0.0)).alias("s"))
    return out.select("n", *[f"recall_at_{k}" for k in ks], F.round(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)), 4).alias("mrr"))


def count_ratio(n, d):
    """(n, d, pct to one decimal, label) as a struct; pct is 0 where d is 0."""
    pct = F.when(d > 0, 100.0 * n / d).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), d.alias("d"), F.bround(pct, 1).alias("pct"), F.concat(n.cast("string"), F.lit("/"), d.cast("string"), F.lit(" ("), F.bround(pct, 0).cast("int").cast("string"), F.lit("%)")).alias("label"))


def answer_counts(rows: DataFrame) -> DataFrame:
    """From (answerable, refused, label, faithful): label histogram over answerable (a refusal is incomplete), faithfulness, refusals."""
    a, r = F.col("answerable"), F.coalesce(F.col("refused"), F.lit(False))
    lab = F.when(r, "incomplete").when(F.col("label").isin("correct", "incomplete", "wrong"), F.col("label")).otherwise("wrong")
    return rows.agg(
        *[F.count_if(a & (lab == x)).alias(x) for x in ("correct", "incomplete", "wrong")],
        F.count_if(a & ~r).alias("answered"),
        F.count_if(a & ~r & F.coalesce(F.col("faithful"), F.lit(False))).alias("faithful"),
        F.count_if(~a & r).alias("refused_unanswerable"),
        F.count_if(~a).alias("unanswerable"),
        F.count_if(a & r).alias("false_refusals"),
        F.count_if(~a & ~r).alias("false_answers"),
    )


def latency(samples: DataFrame, name: str, value: str) -> DataFrame:
    """n, median, nearest-rank p95, least and greatest by name, to two decimals.

    p95 is the value at place round(0.95 (n - 1)), half to even. Ranks come from
    running counts over distinct values, dealt by ranges, so no name's samples
    are collected or pass through one window.
    """
    lo, hi = lambda n: F.floor((n - 1) / 2) + 1, lambda n: F.ceil((n - 1) / 2) + 1
    p95 = lambda n: F.bround(n * 0.95 - 0.95, 0).cast("long") + 1
    got = at_ranks(samples, [name], value, {"_lo": lo, "_hi": hi, "p95_s": p95, "min_s": lambda n: F.lit(1), "max_s": lambda n: n})
    return got.select(name, "n", *[F.round(c, 2).alias(a) for a, c in (("median_s", (F.col("_lo") + F.col("_hi")) / 2), ("p95_s", F.col("p95_s")), ("min_s", F.col("min_s")), ("max_s", F.col("max_s")))])


def average_precision(scored: DataFrame, group: str, item: str, score: str, label: str) -> DataFrame:
    """Mean precision at each positive by group, ranked by score, ties by item. A group may hold most of the rows."""
    rows = scored.select(group, F.col(score).isNull().alias("_none"), (-F.col(score)).alias("_low"), F.col(item).alias("_item"), (F.col(label) == 1).alias("hit"))
    r = running(rows, [group], ["_none", "_low", "_item"], sums={"hits": F.col("hit").cast("int")}, place="_place").withColumn("rank", F.col("_place") + 1)
    return r.groupBy(group).agg(F.coalesce(F.avg(F.when(F.col("hit"), F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("average_precision"), F.count_if("hit").alias("positives"))


def grouped_metrics(per_item: DataFrame, rank: str, dims: list[str], ks=(1, 3, 5, 10), totals: bool = True) -> DataFrame:
    """(dims, level, n, recall_at_k..., mrr) for every combination of dims, and with ``totals`` for every subset of them: grouping sets in one pass.

    ``level`` names the grouping set by its bits, the first of dims highest, 1
    where a dimension is summed over; it tells such a row from one whose value
    is null.
    """
    r = F.col(rank)
    g = per_item.cube(*dims) if totals else per_item.groupBy(*dims)
    level = F.grouping_id() if totals else F.lit(0).cast("long")
    out = g.agg(level.cast("long").alias("level"), F.count("*").alias("n"), *[F.count_if(r <= k).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 4).alias("mrr"))
    return out.select(*dims, "level", "n", *[f"recall_at_{k}" for k in ks], "mrr")


def run_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change) of two runs' items whose value differs or that only one has."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(1).alias("_a")), after.select(key, F.col(value).alias("after"), F.lit(1).alias("_b"))
    j = a.join(b, key, "full_outer").where("_a is null or _b is null or not (before <=> after)")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").when(F.col("after") < F.col("before"), "better").otherwise("worse")
    return j.select(key, "before", "after", kind.alias("change"))


def probe_flips(off: DataFrame, on: DataFrame, key: str, passed: str) -> DataFrame:
    """Passes without and with metadata, their difference, and items that changed either way."""
    j = off.select(key, F.col(passed).alias("a")).join(on.select(key, F.col(passed).alias("b")), key)
    return j.agg(F.count_if("a").alias("passed_off"), F.count_if("b").alias("passed_on"), (F.count_if("b") - F.count_if("a")).alias("delta"), F.count_if(F.expr("not a and b")).alias("fixed"), F.count_if(F.expr("a and not b")).alias("broken"))


def passage_status(passages: DataFrame, in_chunk: DataFrame, in_article: DataFrame, key: str) -> DataFrame:
    """OK where a chunk holds the passage, SPLIT where only an article does, MISSING else."""
    a, b = in_chunk.select(key).distinct().withColumn("_c", F.lit(True)), in_article.select(key).distinct().withColumn("_d", F.lit(True))
    s = F.when(F.col("_c"), "OK").when(F.col("_d"), "SPLIT").otherwise("MISSING")
    return passages.select(key).join(a, key, "left").join(b, key, "left").select(key, s.alias("status"))


def topic_currency(articles: DataFrame, cited: DataFrame, url: str, slug: str, date: str) -> DataFrame:
    """(topic, n_articles, newest, newest_cited) of topics with several articles, letters and weekly campaigns left out; newest by date, ties by url."""
    a = articles.where(~F.col(slug).startswith(T.BULLETIN_PREFIX) & ~F.col(slug).contains(T.ROUNDUP_PART)).withColumn("topic", T.topic(slug))
    top = a.groupBy("topic").agg(F.count("*").alias("n_articles"), F.max_by(F.col(url), F.struct(F.col(date), F.col(url))).alias("newest")).where("n_articles > 1")
    c = cited.select(F.col(url).alias("newest")).distinct().withColumn("_c", F.lit(True))
    return top.join(c, "newest", "left").select("topic", "n_articles", "newest", F.coalesce("_c", F.lit(False)).alias("newest_cited"))


def patient_passage(articles: DataFrame, key: str, body: str, most: int = 400, lines: int = 3) -> DataFrame:
    """(key, passage): up to three non-blank lines after the first patient heading and before advice for professionals, reports or a short yellow-card line."""
    ln = F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1)
    bare = lambda x: F.trim(x, F.lit(SPACES))
    low = lambda x: F.lower(F.replace(bare(x), F.lit("\u0130"), F.lit("i")))  # noqa: E731  (Java lower-cases this I to two code points)
    stop = lambda x: low(x).contains(STOP_PART) | low(x).startswith(STOP_START) | (low(x).contains(STOP_SHORT) & (F.length(x) < 70))
    rows = articles.select(F.col(key), ln.alias("ln"))
    rows = rows.withColumn("from", F.array_position(F.transform("ln", lambda x: low(x).rlike(PATIENT_HEADING)), True).cast("int"))
    rows = rows.withColumn("rest", F.when(F.col("from") > 0, F.slice("ln", F.col("from") + 1, F.greatest(F.size("ln") - F.col("from"), F.lit(0)))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("to", F.array_position(F.transform("rest", stop), True).cast("int"))
    rows = rows.withColumn("rest", F.when(F.col("to") > 0, F.slice("rest", 1, F.col("to") - 1)).otherwise(F.col("rest")))
    kept = F.slice(F.filter(F.transform("rest", bare), lambda x: x != ""), 1, lines)
    return rows.select(key, F.left(F.array_join(kept, " "), F.lit(most)).alias("passage"))
