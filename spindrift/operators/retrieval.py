"""Retrieval: exact vector search, BM25, reciprocal rank fusion, parent collapse, reranking. Ranks are explicit columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.runs import runs
from ..tables import cut

#: Decimals of a score that decide a rank; ties go to the lower position.
DP = 9
#: Query vectors multiplied at once.
BLOCK = 4096
#: Queries, and term weights of queries, that are broadcast at once.
QUERIES, WEIGHTS = 1 << 15, 1 << 20
#: Scores, and products of weights and counts, that a task holds at once.
CELLS = 1 << 19
#: Terms that a task counts before it hands them on.
TERMS = 1 << 19


class Best:
    """The k best (score, item) of each of n queries so far; of equal scores the lower item."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.item = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, s: np.ndarray, items: np.ndarray, of: np.ndarray | None = None) -> None:
        """Scores of all queries, or of those numbered ``of`` (rows), for some items (columns)."""
        if not self.k:
            return
        of = np.arange(len(self.score)) if of is None else of
        last, low = self.score[of, -1:], self.item[of, -1:]
        q, d = np.nonzero((s > last) | ((s == last) & (items < low)))
        if not len(q):
            return
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        score = np.concatenate([self.score[of[rows]].ravel(), s[q[len(rows) * self.k :], d]])
        item = np.concatenate([self.item[of[rows]].ravel(), items[d]])
        o = np.lexsort((item, -score, q))
        n = np.bincount(q, minlength=len(s))[rows]
        o = o[np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n) < self.k]
        self.score[of[rows]], self.item[of[rows]] = score[o].reshape(-1, self.k), item[o].reshape(-1, self.k)

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        ok = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], ok.shape)[ok]), pa.array(self.item[ok]), pa.array(self.score[ok])], names=["query", "item", "score"])


class Held(Best):
    """Best of unrounded scores: those that may count are held, and put among the k best only when they are as many as these.

    A score may count if it reaches the k-th so far, less what rounding can add.
    Until there is one, the k-th of the first scores serves.
    """

    def __init__(self, n: int, k: int):
        super().__init__(n, k)
        self.least, self.held, self.n = np.full((n, 1), -np.inf), [], 0

    def _reach(self, kth: np.ndarray) -> None:
        self.least = np.maximum(self.least, kth - (2 * 10.0**-DP + 1e-15 * np.abs(np.where(np.isinf(kth), 0, kth))))

    def add(self, s: np.ndarray, items: np.ndarray, of: None = None) -> None:
        """Scores of all queries (rows) for some items (columns)."""
        if not self.k:
            return
        if self.item[0, 0] == np.iinfo(np.int64).max and not self.held and s.shape[1] >= self.k:
            self._reach(np.partition(np.where(np.isnan(s), -np.inf, s), -self.k, axis=1)[:, -self.k, None])
        at = np.flatnonzero(s >= self.least)
        q, d = np.divmod(at, s.shape[1])
        self.held.append((q, np.round(s.ravel()[at], DP), items[d]))
        self.n += len(at)
        if self.n >= self.score.size:
            self._fold()

    def _fold(self) -> None:
        if not self.n:
            return
        q, score, item = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        score, item = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.item[rows].ravel(), item])
        o = np.argsort(-score)
        o = o[np.argsort(q[o].astype(np.min_scalar_type(len(self.score))), kind="stable")]  # short keys are sorted by radix
        same = (q[o][1:] == q[o][:-1]) & (score[o][1:] == score[o][:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        run = np.append(0, np.cumsum(~same))
        o[tied] = o[tied][np.lexsort((item[o[tied]], run[tied]))]
        n = np.bincount(q, minlength=len(self.score))[rows]
        o = o[np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n) < self.k]
        self.score[rows], self.item[rows] = score[o].reshape(-1, self.k), item[o].reshape(-1, self.k)
        self._reach(self.score[:, -1:])

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        self._fold()
        return super().batch(ids)


def ranked(scored: DataFrame, query: str, item: str, score: str, k: int, ties=()) -> DataFrame:
    """The k best rows of each query with their rank. The window's limit is applied before its shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *ties, item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _done(hits: DataFrame, sent) -> DataFrame:
    """A block's hits, written, its broadcast given up: however many blocks there are, one is held."""
    out = cut(hits, "hits")
    sent.destroy()
    return out


def dense(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vec: str) -> DataFrame:
    """(query, item, score, rank) of exact inner-product search in double precision.

    The query vectors are broadcast in blocks of bounded size, one at a time (a
    block's k best are written before the next is sent); each task
    multiplies its items with a block and keeps its k best for every query, so
    the shuffle holds k rows per query and task. Queries beyond a block start
    another pass. Ids are integers; null and empty vectors are left out.
    """
    from .. import ship

    ship(items.sparkSession)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query"), F.col(vec).alias("v"))
    rows, parts = items.where(F.col(vec).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(vec).alias("v")), []

    def one(block):
        ids, m = np.array([r[0] for r in block]), np.array([r[1] for r in block], np.float64)
        sent = items.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches):
            ids, m = sent.value
            best, step = Held(len(ids), k), max(1, CELLS // len(ids))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    b = batch.slice(lo, step)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    best.add(m @ x.T, b.column(0).to_numpy())
            yield best.batch(ids)

        return rows.mapInArrow(run, "query long, item long, score double"), sent

    block: list = []
    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            hits, sent = one(block)
            parts.append(_done(ranked(hits, "query", "item", "score", k).drop("rank"), sent))
            block = []
    if block or not parts:
        parts.append(one(block)[0] if block else rows.selectExpr("item as query", "item", "0d as score").limit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, "query", "item", "score", k)


def collapse(children: DataFrame, parents: DataFrame, k: int, pool: int | None = None) -> DataFrame:
    """Child hits (query, item, parent, score, rank) to the k best parents that exist, each by its best child; at most the pool's best children count."""
    pool = pool if pool is not None else max(6 * k, 50)
    w = Window.partitionBy("query", "parent").orderBy("rank")
    best = children.where(F.col("rank") <= pool).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    first = Window.partitionBy("query").orderBy("rank")
    return best.join(parents, "parent").select("query", "parent", F.col("item").alias("matched_child"), "score", F.row_number().over(first).alias("rank")).where(F.col("rank") <= k)


def _summed(held: list) -> pa.Table:
    """(term, df, dl) of tables of (term, df): a row a term, dl null."""
    t = pa.concat_tables([x.select(["term", "df"]) for x in held]).group_by("term").aggregate([("df", "sum")])
    return pa.table({"term": t["term"], "df": t["df_sum"], "dl": pa.nulls(len(t), pa.int64())})


class Lexical:
    """BM25 (k1 1.5, b 0.75; a negative idf becomes a quarter of the mean idf of the vocabulary) over (id, text) rows.

    The vocabulary's counts come from one pass over the texts and are kept until
    ``reset``, which a changed corpus needs.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        self.k1, self.b, self.epsilon = k1, b, epsilon
        self.docs = docs.select(F.col(id_col).alias("item"), F.lower(text_col).alias("low"))
        self._counts = None

    @property
    def counts(self) -> DataFrame:
        """(term, df, dl): documents of each term; the row of the null term has the number of documents and of their tokens."""
        if self._counts is None:
            from .. import ship

            ship(self.docs.sparkSession)

            def run(batches):
                held, rows, words = [], 0, 0
                for batch in batches:
                    size, tokens = runs(batch.column(0))
                    rows, words = rows + len(size), words + int(size.sum())
                    coded = tokens.dictionary_encode()
                    n = max(1, len(coded.dictionary))
                    each = np.unique(np.repeat(np.arange(len(size)), size) * np.int64(n) + coded.indices.to_numpy()) % n
                    held.append(pa.table({"term": coded.dictionary, "df": np.bincount(each, minlength=n)[: len(coded.dictionary)]}))
                    if sum(map(len, held)) > TERMS:
                        held = [_summed(held)]
                        if len(held[0]) > TERMS // 2:
                            yield from held.pop().to_batches()
                if held:
                    yield from _summed(held).to_batches()
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows]), pa.array([words])], names=["term", "df", "dl"])

            each = self.docs.select("low").mapInArrow(run, "term string, df long, dl long")
            self._counts = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0").persist()
        return self._counts

    def reset(self) -> None:
        """Forget the counts."""
        if self._counts is not None:
            self._counts.unpersist()
        self._counts = None

    @property
    def size(self) -> tuple[int, float]:
        """Documents and mean number of tokens."""
        r = self.counts.where("term is null").first()
        return (r.df, (r.dl / r.df) or 1.0) if r else (0, 1.0)

    @property
    def idf(self) -> DataFrame:
        n = self.size[0]
        raw = self.counts.where("term is not null").select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        return raw.select("term", "df", F.when(F.col("raw") < 0, mean * self.epsilon).otherwise(F.col("raw")).alias("idf"))

    def weights(self, queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
        """(query, ws): each query's known terms with idf times occurrences."""
        terms = queries.select(F.col(query_id).cast("long").alias("query"), F.explode(T.lexical_tokens(text_col)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        weight = terms.join(self.idf.select("term", "idf"), "term").groupBy("query").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("ws"))
        return queries.select(F.col(query_id).cast("long").alias("query")).distinct().join(weight, "query", "left")

    def top(self, queries: DataFrame, query_id: str, text_col: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """(query, item, score, rank), the k best of every query, or with ``among`` (item) the k best of those items; ids are integers.

        Every item is ranked: one that shares no term scores 0 and stands before
        those of negative scores, equal scores go by position. Weights of up to
        ``QUERIES`` queries are broadcast at once, bounded in number, and written
        off before the next; a task
        turns its items' counts into scores for all of them in one pass over the
        texts and keeps k a query, so the shuffle holds k rows per query and
        task instead of a row for each shared term.
        """
        src = self.docs.select(F.col("item").cast("long").alias("item"), "low")
        src = src if among is None else src.join(among.select(F.col("item").cast("long").alias("item")).distinct(), "item", "left_semi")

        def fold(ids):
            best = Best(len(ids), k)
            return best.add, lambda: best.batch(ids)

        out = self._folded(self.weights(queries, query_id, text_col), src, fold, "query long, item long, score double")
        return ranked(out, "query", "item", "score", k)

    def places(self, queries: DataFrame, query_id: str, text_col: str, found: DataFrame) -> DataFrame:
        """(query, item, score, rank) of found (query, item, score), a row a query: its rank among all items. Items before it are counted in the tasks, not ranked."""
        w = self.weights(queries, query_id, text_col).join(found.select("query", F.col("score").alias("least"), "item"), "query")

        def fold(ids, least, item):
            n = np.zeros(len(ids), np.int64)

            def add(s, items):
                n[:] += ((s > least[:, None]) | ((s == least[:, None]) & (items < item[:, None]))).sum(1)

            return add, lambda: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["query", "n"])

        src = self.docs.select(F.col("item").cast("long").alias("item"), "low")
        out = self._folded(w, src, fold, "query long, n long", ("least", "item"))
        return found.select("query", "item", "score").join(out.groupBy("query").agg((F.sum("n") + 1).cast("int").alias("rank")), "query")

    def _folded(self, weights: DataFrame, src: DataFrame, fold, schema: str, more: tuple = ()) -> DataFrame:
        """What ``fold(ids, *more)`` makes of the scores of all items: it gives a function that takes (scores, items) of a piece, and one that ends a task with a batch."""
        from .. import ship

        spark = self.docs.sparkSession
        ship(spark)
        avgdl, k1, b = self.size[1], self.k1, self.b

        def one(block):
            names = sorted({w.term for r in block for w in r.ws or ()})
            at = {t: i for i, t in enumerate(names)}
            cells = sorted((at[w.term], j, w.w) for j, r in enumerate(block) for w in r.ws or ())
            term, who, weight = np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64), np.array([c[2] for c in cells], float)
            sent = spark.sparkContext.broadcast((np.array([r["query"] for r in block], np.int64), names, np.searchsorted(term, np.arange(len(names) + 1)), who, weight, [np.array([r[c] for r in block]) for c in more]))

            def run(batches):
                ids, names, ptr, who, weight, rest = sent.value
                add, end = fold(ids, *rest)
                known, step = pa.array(names, pa.string()), max(1, CELLS // max(1, len(ids)))
                for batch in batches:
                    size, tokens = runs(batch.column(1))
                    term = pc.fill_null(pc.index_in(tokens, known), -1).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(len(size)), size)[term >= 0]
                    key, tf = np.unique(doc * np.int64(max(1, len(names))) + term[term >= 0], return_counts=True)
                    doc, term = np.divmod(key, max(1, len(names)))
                    x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avgdl))
                    n, items, lo = ptr[term + 1] - ptr[term], batch.column(0).to_numpy(), 0
                    upto = np.append(0, np.cumsum(np.bincount(doc, n, len(size))))
                    while lo < len(size):
                        hi = min(lo + step, len(size), max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, "right")) - 1))
                        part = slice(*np.searchsorted(doc, (lo, hi)))
                        t, m = term[part], n[part]
                        cell = np.repeat(ptr[t] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        s = np.bincount(who[cell] * (hi - lo) + np.repeat(doc[part] - lo, m), np.repeat(x[part], m) * weight[cell], len(ids) * (hi - lo))
                        add(np.round(s, DP).reshape(len(ids), hi - lo), items[lo:hi])
                        lo = hi
                yield end()

            return src.mapInArrow(run, schema), sent

        parts, block, held = [], [], 0
        for r in weights.toLocalIterator():
            block.append(r)
            held += len(r.ws or ())
            if len(block) == QUERIES or held >= WEIGHTS:
                parts.append(_done(*one(block)))
                block, held = [], 0
        if block:
            parts.append(one(block)[0])
        if not parts:  # no query, no score
            return spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def pool_size(k: int, times: int = 10, least: int = 50) -> int:
    return max(times * k, least)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two (query, item, rank) tables; ties: dense ranks first, then lexical ranks."""
    # joined and not united: Spark 4.1 takes a union of equally dealt inputs as dealt so itself, which fails where an input's exchange is reused
    both = dense_hits.select("query", "item", F.col("rank").alias("dense_rank")).join(lexical_hits.select("query", "item", F.col("rank").alias("lexical_rank")), ["query", "item"], "full_outer")
    term = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", term("dense_rank") + term("lexical_rank"))
    return ranked(scored, "query", "item", "score", k, (F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")))


def overlap_score(query_text: str, item_text: str):
    """The built-in pair scorer: Jaccard similarity of lexical token sets."""
    a, b = F.array_distinct(T.lexical_tokens(query_text)), F.array_distinct(T.lexical_tokens(item_text))
    union = F.size(F.array_union(a, b))
    return F.round(F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0)), DP)


def rerank(hits: DataFrame, score, k: int) -> DataFrame:
    """Hits with texts, reordered by a pair score (a Column, such as a pandas UDF of a model); ties keep their order."""
    w = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "rank")
    out = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "base_rank").withColumn("rank", F.row_number().over(w.partitionBy("query").orderBy(F.desc("rerank_score"), "base_rank")))
    return out.where(F.col("rank") <= k)
