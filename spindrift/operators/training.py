"""Pairs for training a reranker: leakage exclusion, hard negatives, seeded order, exact splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import cut, numbered
from .evaluation import containment


def gold_passages(gold: DataFrame, passages: str = "supporting_passages") -> DataFrame:
    return gold.select("id", F.explode(passages).alias("p")).select("id", "p.*")


def without_leaks(chunks: DataFrame, passages: DataFrame, chunk_id: str, chunk_text: str, passage_id: str, passage: str) -> DataFrame:
    """Chunks that hold no gold passage."""
    bad = containment(passages, chunks, passage_id, passage, chunk_id, chunk_text)
    return chunks.join(bad.select(chunk_id).distinct(), chunk_id, "left_anti")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place`` from 1, a seeded order of the rows: by md5 of seed and key, ties by key."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return numbered(hashed, "_h", key, name="place").withColumn("place", F.col("place") + 1).drop("_h")


def until_target(rows: DataFrame, place: str, count: str, target: int, block: int = 1 << 16) -> DataFrame:
    """Rows in order while fewer than ``target`` were counted before: the last may overshoot.

    Sums of blocks of places say where each block starts, so that only their
    sums stand in one task; blocks that start beyond the target are left out.
    """
    rows = rows.withColumn("_k", F.floor(F.col(place) / block))
    until = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_k").agg(F.sum(count).alias("_s")).select("_k", F.coalesce(F.sum("_s").over(until.orderBy("_k")), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum(count).over(until.partitionBy("_k").orderBy(place)), F.lit(0))
    return rows.join(sums.where(F.col("_b") < target), "_k").withColumn("_b", F.col("_b") + inner).where(F.col("_b") < target).drop("_b", "_k")


def hard_negatives(hits: DataFrame, positives: DataFrame, banned: DataFrame) -> DataFrame:
    """The best hit (query, item, rank) of each query that is neither its positive (query, item) nor banned (item)."""
    rest = hits.join(positives, ["query", "item"], "left_anti").join(banned.select("item").distinct(), "item", "left_anti")
    return rest.groupBy("query").agg(F.min_by("item", "rank").alias("item"), F.min("rank").alias("rank"))


def mined(lexical, queries: DataFrame, positives: DataFrame, banned: DataFrame, query_id: str, text_col: str, first: int = 50) -> DataFrame:
    """``hard_negatives`` over the ranking of all items by ``retrieval.Lexical``: (query, item, rank).

    Queries whose ``first`` best are all banned rank only the items that aren't,
    and only as many as a query has positives and one; the rank among all items
    is then counted. So no query asks for more than a bounded number of hits.
    """
    found = cut(hard_negatives(lexical.top(queries, query_id, text_col, first), positives, banned), "negatives")
    rest = cut(queries.join(found.select(F.col("query").alias(query_id)), query_id, "left_anti").select(query_id, text_col), "rest")
    if not rest.limit(1).count():
        return found
    most = positives.groupBy("query").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    free = lexical.docs.select("item").join(banned.select("item").distinct(), "item", "left_anti")
    hits = lexical.top(rest, query_id, text_col, most + 1, among=free).join(positives, ["query", "item"], "left_anti")
    best = cut(hits.groupBy("query").agg(F.min_by(F.struct("item", "score"), "rank").alias("b")).select("query", "b.*"), "best")
    return found.unionByName(lexical.places(rest, query_id, text_col, best).select("query", "item", "rank"))


def pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.select("query", "item", F.lit(1).alias("label")).unionByName(negatives.select("query", "item", F.lit(0).alias("label")))


def split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``part``: exactly max(1, floor(n share)) rows are val, the first in the seeded order."""
    s = shuffled(rows, key, seed)
    n = s.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_n"))
    return s.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("place") <= F.col("_n"), "val").otherwise("train")).drop("place", "_n")


def questions(raw: str, most: int):
    """Generated lines to questions: leading numbering stripped, kept if over 12 characters and ending in a question mark, the first ``most``."""
    lines = F.transform(F.split(F.coalesce(F.col(raw), F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[0-9.\-) ]+", "")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 12) & x.endswith("?")), 1, most)


def pair_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def pair_array(question: str, text: str):
    """Features of a question and a text as an array: Jaccard similarity, share of the question's words held, share of its adjacent pairs held, log length."""

    def share(part, whole):
        return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))

    def two(c):
        return T.let(T.lexical_tokens(c), lambda t: F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b))))

    q, t = F.array_distinct(T.lexical_tokens(question)), F.array_distinct(T.lexical_tokens(text))
    union = F.size(F.array_union(q, t))
    jaccard = F.when(union > 0, F.size(F.array_intersect(q, t)) / union).otherwise(F.lit(0.0))
    return F.array(jaccard, share(q, t), share(two(question), two(text)), F.log1p(F.size(t)))


def pair_features(rows: DataFrame, question: str, text: str) -> DataFrame:
    """Adds ``features``, the vector of ``pair_array``."""
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(pair_array(question, text)))


def fit_scorer(train: DataFrame, val: DataFrame, question: str, text: str, label: str = "label", rounds: int = 50, penalty: float = 0.01):
    """(model, report): a pair scorer by logistic regression on ``pair_features`` (the offline stand-in for tuning a cross-encoder on the same loss).

    The report has average precision on val before (question's words held) and
    after, on a part of train as large as val, and the gap of the last two.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from .evaluation import average_precision

    a, b = pair_features(train, question, text), pair_features(val, question, text)
    model = LogisticRegression(labelCol=label, maxIter=rounds, regParam=penalty).fit(a.select("features", F.col(label).cast("double").alias(label)))

    def precision(rows, score):
        rows = rows.select(F.lit(0).alias("g"), F.monotonically_increasing_id().alias("i"), score.alias("s"), F.col(label).cast("int").alias("y"))
        got = average_precision(rows, "g", "i", "s", "y").first()
        return round(got.average_precision, 4) if got else 0.0

    after = lambda rows: precision(model.transform(rows), vector_to_array("probability")[1])
    before, val_after, probe = precision(b, vector_to_array("features")[1]), after(b), after(a.limit(val.count()))
    return model, {"val_before": before, "val_after": val_after, "train_probe": probe, "gap": round(probe - val_after, 4)}
