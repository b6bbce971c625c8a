"""Exact vector search that skips clusters: none is read for a query whose bound says that it can't reach the k best."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship, tables
from .retrieval import CELLS, DP, Best, ranked

#: Vectors from which the centres are learned, and the most centres.
SAMPLE, MOST = 8192, 1024
#: Queries searched at once.
QUERIES = 4096
#: Clusters of a query that are searched first, for a bound on its k-th score.
SEEDS = 3


def centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """n centres of a sample by Lloyd's rounds, begun at vectors drawn by their distance; fewer where the sample has fewer unlike vectors."""
    rng = np.random.default_rng(seed)
    c = sample[:1]
    d2 = ((sample - c[0]) ** 2).sum(1)
    while len(c) < n and d2.max(initial=0) > 0:
        step = min(max(1, len(c)), n - len(c))  # as many more as there are, so log2(n) passes
        new = sample[rng.choice(len(sample), min(step, int((d2 > 0).sum())), replace=False, p=d2 / d2.sum())]
        c = np.concatenate([c, new])
        d2 = np.minimum(d2, ((sample**2).sum(1)[:, None] - 2 * sample @ new.T + (new**2).sum(1)).min(1).clip(0))
    for _ in range(rounds):
        at = ((c**2).sum(1) - 2 * sample @ c.T).argmin(1)
        size = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class Clusters:
    """Vectors in a folder, sorted by cluster: ``vectors`` (cluster, item, v) and ``centres`` (cluster, centre, radius, n)."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(items: DataFrame, item_id: str, vec: str, path: str, n: int | None = None, sample: int = SAMPLE) -> Clusters:
        """Write every vector under its nearest centre. Centres (the root of the number of vectors, ``MOST`` at most) are learned
        from ``sample`` vectors, those of least hash of the id; null and empty vectors are left out."""
        spark = items.sparkSession
        ship(spark)
        rows = items.where(F.size(F.col(vec)) > 0).select(F.col(item_id).cast("long").alias("item"), F.col(vec).cast("array<double>").alias("v"))
        some = rows.orderBy(F.xxhash64("item"), "item").limit(sample).select("v").collect()
        count = rows.count()
        c = centres(np.array([r.v for r in some], np.float64), n or max(1, min(MOST, round(count**0.5)))) if some else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(c)

        def run(batches):
            c = sent.value
            own = (c * c).sum(1)
            for batch in batches:
                for lo in range(0, batch.num_rows, step := max(1, CELLS // max(1, len(c)))):
                    b = batch.slice(lo, step)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    at = (own - 2 * x @ c.T).argmin(1)
                    far = np.sqrt(((x - c[at]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1), pa.array(far)], names=["cluster", "item", "v", "far"])

        dealt = rows.mapInArrow(run, "cluster int, item long, v array<double>, far double") if some else rows.select(F.lit(0).alias("cluster"), "item", "v", F.lit(0.0).alias("far"))
        dealt.repartitionByRange("cluster", "item").sortWithinPartitions("cluster", "item").write.mode("overwrite").parquet(f"{path}/vectors")
        known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster int, centre array<double>")
        size = spark.read.parquet(f"{path}/vectors").groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        known.join(size, "cluster").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return Clusters(spark, path)

    def search(self, queries: DataFrame, query_id: str, vec: str, k: int) -> tuple[DataFrame, int, int]:
        """(hits, met, all): the rows of ``retrieval.dense``, how many (query, vector) pairs were scored, and how many there are.

        A vector of a cluster adds at most |query| times the cluster's radius to
        the query's score with the centre. The clusters of the highest bounds
        are searched first; of the others those whose bound reaches the k-th
        score so far. Queries pass by ``QUERIES`` at once, one block after the
        other, and only clusters that some query of the block needs are read.
        """
        ship(self.spark)
        q = queries.where(F.size(F.col(vec)) > 0).select(F.col(query_id).cast("long").alias("query"), F.col(vec).cast("array<double>").alias("v"))
        info = self.spark.read.parquet(f"{self.path}/centres").orderBy("cluster").collect()  # MOST rows at most
        n, met, asked, parts, block = sum(r.n for r in info), 0, 0, [], []

        def one(rows):
            ids, m = np.array([r["query"] for r in rows]), np.array([r.v for r in rows], np.float64)
            names, size = np.array([r.cluster for r in info]), np.array([r.n for r in info])
            c, radius = np.array([r.centre for r in info]), np.array([r.radius for r in info])
            # a margin for rounded scores and sums
            bound = m @ c.T + np.sqrt((m * m).sum(1))[:, None] * radius + 1e-6
            order = np.argsort(-bound, axis=1, kind="stable")
            enough = np.cumsum(size[order], 1) >= k
            first = np.maximum(SEEDS, np.where(enough.any(1), enough.argmax(1) + 1, len(names)))
            seed = np.zeros(bound.shape, bool)
            for i in range(len(ids)):
                seed[i, order[i, : first[i]]] = True
            a = tables.cut(self._scored(ids, m, names, seed, k), "near")
            kth = {r["query"]: r.score for r in ranked(a, "query", "item", "score", k).where(F.col("rank") == k).collect()}
            rest = ~seed & (bound >= np.array([kth.get(i, -np.inf) for i in ids.tolist()])[:, None])
            out = [a]
            if rest.any():
                out.append(tables.cut(self._scored(ids, m, names, rest, k), "near"))
            return out, int((size * (seed | rest)).sum())

        for r in q.toLocalIterator():
            block.append(r)
            asked += 1
            if len(block) == QUERIES:
                out, pairs = one(block) if info else ([], 0)
                parts, met, block = parts + out, met + pairs, []
        if block and info:
            out, pairs = one(block)
            parts, met = parts + out, met + pairs
        hits = parts[0] if parts else self.spark.createDataFrame([], "query long, item long, score double")
        for p in parts[1:]:
            hits = hits.unionByName(p)
        return ranked(hits, "query", "item", "score", k), met, asked * n

    def _scored(self, ids, m, names, wanted, k: int) -> DataFrame:
        """The k best of each query and task among the clusters that it wants."""
        needed = names[wanted.any(0)].tolist()
        sent = self.spark.sparkContext.broadcast((ids, m, {int(x): np.flatnonzero(wanted[:, i]) for i, x in enumerate(names) if wanted[:, i].any()}))
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("cluster").isin(needed)).select("cluster", "item", "v")

        def run(batches):
            ids, m, who = sent.value
            best = Best(len(ids), k)
            for batch in batches:
                cluster = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi > lo and (of := who.get(int(cluster[lo]))) is not None:
                        for a in range(lo, hi, step := max(1, CELLS // len(of))):
                            b = batch.slice(a, min(step, hi - a))
                            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                            best.add(np.round(m[of] @ x.T, DP), b.column(1).to_numpy(), of)
            yield best.batch(ids)

        return rows.mapInArrow(run, "query long, item long, score double")

    def top(self, queries: DataFrame, query_id: str, vec: str, k: int) -> DataFrame:
        return self.search(queries, query_id, vec, k)[0]
