"""A stored inverted index: postings by term and block of items, each block with the most it can add, so that a search reads only blocks that can matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import text as T
from ..functions.runs import runs
from .retrieval import DP, ranked

#: Items of a block.
BLOCK = 256
#: Blocks of a query that are scored first, for a bound on its k-th score.
SEEDS = 4
#: Rows of query weights that are broadcast at once.
WEIGHTS = 1 << 20
#: Terms that are handed to the Parquet reader, which skips row groups without them.
PUSHED = 256
STATS = "version string, n long, avgdl double, low double, k1 double, b double, block long"


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, dl, term, tf) of every term of every text, counted where the text is: no shuffle."""

    def run(batches):
        for batch in batches:
            size, tokens = runs(batch.column(1))
            coded = tokens.dictionary_encode()
            n = max(1, len(coded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(size)), size) * np.int64(n) + coded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(key, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(size[doc]), coded.dictionary.take(pa.array(term)), pa.array(tf)], names=["item", "dl", "term", "tf"])

    return _lowered(docs, id_col, text_col).mapInArrow(run, "item long, dl long, term string, tf long")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, dl) of every text, empty ones included."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs(batch.column(1))[0])], names=["item", "dl"])

    return _lowered(docs, id_col, text_col).mapInArrow(run, "item long, dl long")


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from .. import ship

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("item"), F.lower(text_col).alias("low"))


@dataclass
class Postings:
    """BM25 over an index in a folder: ``postings`` (term, block, n, best, items, gains), ``terms`` (term, df), ``items`` (item, dl, no), ``stats``.

    A gain is what a term adds to an item's score but for the query's weight.
    """

    spark: SparkSession
    path: str
    version: str
    n: int
    avgdl: float
    low: float
    block: int

    @staticmethod
    def build(counts: DataFrame, sizes: DataFrame, path: str, version: str = "", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = BLOCK) -> Postings:
        """Write the index of ``token_counts`` and ``lengths``. The statistics come last: a folder without them is no index.

        Postings of a term are dealt by blocks, so a word of every text is in no
        task as a whole. Terms lie in ranges, so that few files hold a query's.
        """
        spark = counts.sparkSession
        tables.numbered(sizes, "item", name="no").write.mode("overwrite").parquet(f"{path}/items")
        r = spark.read.parquet(f"{path}/items").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        avgdl = (r.dl / r.n if r.n else 0) or 1.0
        gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        each = counts.select("term", F.floor(F.col("item") / block).alias("block"), F.struct("item", gain.alias("gain")).alias("p"))
        # dealt by ranges before they are gathered, so that postings are shuffled once
        rows = each.repartitionByRange("term", "block").groupBy("term", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
        rows = rows.select("term", "block", F.size("p").cast("long").alias("n"), F.array_max("p.gain").alias("best"), F.col("p.item").alias("items"), F.col("p.gain").alias("gains"))
        rows.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
        df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"))
        df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        mean = spark.read.parquet(f"{path}/terms").agg(F.avg(_raw(r.n))).first()[0] or 0.0
        spark.createDataFrame([(version, r.n, avgdl, mean * epsilon, k1, b, block)], STATS).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return Postings.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, version: str | None = None) -> Postings:
        """The index in a folder: FileNotFoundError where there is none, ValueError where it is of another version."""
        from pyspark.errors import AnalysisException

        try:
            s = spark.read.schema(STATS).parquet(f"{path}/stats").first()
        except AnalysisException as e:
            raise FileNotFoundError(f"no index in {path}") from e
        if version is not None and s.version != version:
            raise ValueError(f"the index in {path} is of version {s.version!r}, not {version!r}")
        return Postings(spark, path, s.version, s.n, s.avgdl, s.low, s.block)

    @staticmethod
    def current(docs: DataFrame, id_col: str, text_col: str, path: str, version: str) -> Postings:
        """The index of this version of a corpus (its snapshot's id), built where it isn't there yet. Older versions stay beside it for who still reads them."""
        at = f"{path}/{version}"
        try:
            return Postings.open(docs.sparkSession, at, version)
        except FileNotFoundError:
            return Postings.build(token_counts(docs, id_col, text_col), lengths(docs, id_col, text_col), at, version)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def idf(self) -> DataFrame:
        """(term, df, idf); a negative idf becomes epsilon times the vocabulary's mean."""
        raw = self.read("terms").withColumn("raw", _raw(self.n))
        return raw.select("term", "df", F.when(F.col("raw") < 0, self.low).otherwise(F.col("raw")).alias("idf"))

    def weights(self, queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
        """(query, term, w): each query's known terms with idf times occurrences."""
        t = queries.select(F.col(query_id).cast("long").alias("query"), F.explode(T.lexical_tokens(text_col)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        return t.join(self.idf, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("w"))

    def _of(self, weights: DataFrame, columns: list[str]) -> DataFrame:
        """Columns of the blocks of the queries' terms; a few terms are pushed down to the files."""
        rows, names = self.read("postings").select(*columns), weights.select("term").distinct()
        some = [r.term for r in names.limit(PUSHED + 1).collect()]
        if len(some) <= PUSHED:
            own = F.lit(False)
            for i in range(0, len(some), 10):  # longer lists would be pushed down as a range
                own = own | F.col("term").isin(some[i : i + 10])
            return rows.where(own)
        return rows.join(F.broadcast(names), "term", "left_semi")

    def _scored(self, chosen: DataFrame, weights: DataFrame) -> DataFrame:
        """(query, item, score) of the items of chosen (query, block)."""
        asked = chosen.select("query", "block").join(F.broadcast(weights), "query")
        rows = self._of(weights, ["term", "block", "items", "gains"]).join(asked, ["term", "block"])
        flat = rows.select("query", "w", F.explode(F.arrays_zip("items", "gains")).alias("p"))
        return flat.groupBy("query", F.col("p.items").alias("item")).agg(F.round(F.sum(F.col("w") * F.col("p.gains")), DP).alias("score"))

    def _batch(self, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Scores of all items that can be among the k best of their query, and the blocks read, for weights of bounded number."""
        gain = F.greatest(F.col("w") * F.col("best"), F.lit(0.0))
        bounds = self._of(weights, ["term", "block", "n", "best"]).join(F.broadcast(weights), "term").groupBy("query", "block").agg(F.sum(gain).alias("most"), F.sum("n").alias("n"))
        bounds = tables.cut(ranked(bounds, "query", "block", "most", 1 << 30).withColumnRenamed("rank", "place"), "bounds")
        seeds = SEEDS + -(-k // self.block)
        first = tables.cut(self._scored(bounds.where(F.col("place") <= seeds), weights), "scored")
        kth = ranked(first, "query", "item", "score", k).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        # sums differ in their last bits by their order, scores are rounded: a margin
        rest = bounds.where(F.col("place") > seeds).join(F.broadcast(kth), "query", "left").where("kth is null or most >= kth - 1e-6").drop("kth")
        rest = tables.cut(rest, "rest")
        more = self._scored(rest, weights)
        used = bounds.where(F.col("place") <= seeds).select("query", "block", "n").unionByName(rest.select("query", "block", "n"))
        return tables.cut(first.unionByName(more), "found"), used

    def search(self, queries: DataFrame, query_id: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
        """(hits, blocks read): the k best (query, item, score, rank) of every query, as ``Lexical.top`` ranks them, and (query, block, n) with the postings of each block scored.

        Every block has an upper bound for each query from its terms' best gains,
        which are read without the postings. The best blocks are scored first;
        the others only if their bound reaches the k-th score found. Query
        weights are broadcast by at most ``WEIGHTS`` at once, one batch after the
        other. Null and empty questions get the first k items with score 0.
        """
        w = tables.cut(self.weights(queries, query_id, text_col), "weights")
        n = max(1, -(-w.count() // (WEIGHTS // 2)))
        got = [self._batch(w if n == 1 else tables.cut(w.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i), "batch"), k) for i in range(n)]
        found, used = got[0]
        for a, b in got[1:]:
            found, used = found.unionByName(a), used.unionByName(b)
        best = ranked(found, "query", "item", "score", k).drop("rank")
        asked = queries.select(F.col(query_id).cast("long").alias("query")).distinct()
        have = found.groupBy("query").agg(F.count("*").alias("met"), F.count_if(F.col("score") > 0).alias("good"))
        short = tables.cut(asked.join(have, "query", "left").where(F.coalesce("good", F.lit(0)) < k).select("query", F.coalesce("met", F.lit(0)).alias("met")), "short")
        # items that share no term score 0: the first ones that a query hasn't met
        places = short.select("query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("met") + k - 1)).alias("no"))
        zero = places.join(self.read("items").select("item", "no"), "no").join(found.select("query", "item"), ["query", "item"], "left_anti")
        hits = ranked(best.unionByName(zero.select("query", "item", F.lit(0.0).alias("score"))), "query", "item", "score", k)
        return hits, used

    def top(self, queries: DataFrame, query_id: str, text_col: str, k: int) -> DataFrame:
        return self.search(queries, query_id, text_col, k)[0]


def _raw(n: int):
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
