"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks in double precision.

Vectors of cosine c stand at Euclidean distance sqrt(2 - 2c) once normalised, so
h(x) = floor((a.x + b) / w), a Gaussian and b uniform in [0, w), agrees for near
vectors. ``K`` such values name a bucket, in each of ``TABLES`` tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import as_long, mix
from .shared import SALTS, arrow, components, cut, drop

COSINE = 0.95
#: With w = 1.5, one of 48 tables of 12 values holds a pair at the threshold with probability 0.996 and one of cosine 0.98
#: but for 5e-7; a pair at right angles meets in 0.05 % of cases.
K, TABLES, WIDTH, SEED = 12, 48, 1.5, 20
#: Vectors of one bucket in a block; groups up to this size are compared many at once.
BLOCK, SMALL = 1024, 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; the largest component is divided out first, so no length overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, tables: int = TABLES, k: int = K, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table, as 64-bit hashes. The projections come from the seed and the dimension."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], tables * k)), rng.random(tables * k) * width
    q = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        h = mix(h + q[:, :, i])
    return as_long(h)


def _hash_rows(rows: DataFrame, tables: int, k: int, width: float, seed: int) -> DataFrame:
    def run(batches):
        for b in batches:
            vec = b.column(1)
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes):
                on = np.flatnonzero(sizes == n)
                keys = bucket_keys(unit(flat[at[on][:, None] + np.arange(n)]), tables, k, width, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))], names=["node", "keys"])

    return arrow(rows.select("node", "v"), run, "node long, keys array<bigint>")


def _candidates(i, j, block, first: np.ndarray, u: np.ndarray, least: float):
    """Linked rows (x, y) inside the groups that start at ``first``; u has the unit vectors. Groups of one small size are compared together, a large one by matrix products."""
    size = np.diff(np.append(first, len(u)))
    for n in np.unique(size):
        at = first[size == n]
        if n < 2:
            continue
        if n <= SMALL:
            p, q = np.triu_indices(n, 1)
            step = max(1, 200_000 // len(p))
            for k in range(0, len(at), step):
                x, y = (at[k : k + step, None] + p).ravel(), (at[k : k + step, None] + q).ravel()
                on = (i[x] == j[x]) | (block[x] != block[y])
                x, y = x[on], y[on]
                on = np.einsum("ij,ij->i", u[x], u[y]) >= least
                yield x[on], y[on]
            continue
        for a in at.tolist():
            rows = np.arange(a, a + n)
            left = rows[block[rows] == i[a]]
            right = left if i[a] == j[a] else rows[block[rows] == j[a]]
            for k in range(0, len(left), 1024):
                x, y = np.nonzero(u[left[k : k + 1024]] @ u[right].T >= least - 1e-9)
                x, y = left[k + x], right[y]
                if i[a] == j[a]:
                    x, y = x[x < y], y[x < y]
                on = np.concatenate([np.einsum("ij,ij->i", u[x[z : z + 100_000]], u[y[z : z + 100_000]]) >= least for z in range(0, len(x), 100_000)] or [np.zeros(0, bool)])
                yield x[on], y[on]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links x - y."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(rows: DataFrame, least: float, hashing: tuple) -> DataFrame:
    """From rows (t, key, i, j, block, node, copies, v): (a, b, n), n links of a from the copies it met (then b = a), or n = 0 and a is connected with b."""

    def sums(f, u, x, y):
        # a pair that meets in an earlier table too is left to that
        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        keys = bucket_keys(u[used], *hashing)
        kx, ky, tx = back[: len(x)], back[len(x) :], f[0][x]
        once = np.ones(len(x), bool)
        for k in range(hashing[0] - 1):
            later = np.flatnonzero((tx > k) & once)
            once[later] = keys[kx[later], k] != keys[ky[later], k]
        x, y = x[once], y[once]
        n = np.bincount(x, f[6][y], len(u)).astype(np.int64) + np.bincount(y, f[6][x], len(u)).astype(np.int64)
        low = _forest(len(u), x, y)
        some, tied, name = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(u))), f[5]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([name[some], name[tied]])), pa.array(np.concatenate([name[some], name[low[tied]]])), pa.array(np.concatenate([n[some], np.zeros(len(tied), np.int64)]))], names=["a", "b", "n"])

    def work(b: pa.RecordBatch):
        t, key, i, j, block, node, copies = (b.column(k).to_numpy() for k in range(7))
        vec = b.column(7)
        sizes, flat = np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for d in np.unique(sizes):  # vectors of different dimensions don't meet
            on = np.flatnonzero(sizes == d)
            u = unit(flat[at[on][:, None] + np.arange(d)])
            f = [c[on] for c in (t, key, i, j, block, node, copies)]
            turn = np.ones(len(on), bool)
            turn[1:] = (f[0][1:] != f[0][:-1]) | (f[1][1:] != f[1][:-1]) | (f[2][1:] != f[2][:-1]) | (f[3][1:] != f[3][:-1])
            for x, y in _candidates(f[2], f[3], f[4], np.flatnonzero(turn), u, least):
                if len(x):
                    yield sums(f, u, x, y)

    def run(batches):
        held: list = []
        for b in batches:
            last = [b.column(k)[b.num_rows - 1].as_py() for k in range(4)] if b.num_rows else None
            if last is None:
                continue
            same = np.ones(b.num_rows, bool)
            for k in range(4):
                same &= b.column(k).to_numpy() == last[k]
            cut_at = b.num_rows - int(same[::-1].argmin() if not same.all() else b.num_rows)  # the last group may go on
            if cut_at:
                whole = pa.Table.from_batches([*held, b.slice(0, cut_at)]).combine_chunks().to_batches()
                for w in whole:
                    yield from work(w)
                held = []
            elif held and any(held[-1].column(k)[0].as_py() != last[k] for k in range(4)):
                for w in pa.Table.from_batches(held).combine_chunks().to_batches():
                    yield from work(w)
                held = []
            held.append(b.slice(cut_at))
        if held:
            for w in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from work(w)

    order = ["t", "key", "i", "j"]
    return arrow(rows.repartition(*order).sortWithinPartitions(*order).select(*order, "block", "node", "copies", "v"), run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col="vec_id", vec_col="embedding", least: float = COSINE, tables: int = TABLES, k: int = K, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, n_links, component) for each row: other rows linked directly, and the least id reachable over links.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; vectors of different dimensions never link; equal vectors
    always do, also where several rows share an id; empty tables give none.
    Equal vectors are compared once and weigh as many rows as they stand on.
    Buckets are met in blocks of bounded size and give sums and a spanning
    forest, never their pairs. A pair is counted in the first table it meets in.
    """
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = dict(vectors.dtypes)[vec_col]
    src = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x))).alias("v"))
    named = src.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    # equal vectors once each; the name is a 64-bit hash of all components
    nodes = cut(named.where("v is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("low")), "vectors")
    full = cut(nodes.join(_hash_rows(nodes, tables, k, width, seed), "node"), "hashed")
    filed = full.select("node", F.posexplode("keys").alias("t", "key"))
    hot = filed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    met = filed.join(hot, ["t", "key"]).withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("t", "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node")
    got = cut(_links(met.join(full.select("node", "copies", "v"), "node"), least, (tables, k, width, seed)), "links")
    n = got.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    labels = components(got.where("n = 0").select("a", "b"))
    drop(full)
    low = labels.join(nodes.select("node", "low"), "node").groupBy("label").agg(F.min("low").alias("least"))
    whole = nodes.select("node", "low", "copies").join(n, "node", "left").join(labels.join(low, "label").select("node", "least"), "node", "left")
    whole = whole.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component"))
    # rows of one vector are dealt to several tasks, as it may stand on a third of all
    whole = whole.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = named.select("id", "node", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_s"))
    return dealt.join(whole, ["node", "_s"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def vector_report(vectors: DataFrame) -> DataFrame:
    out = near_vectors(vectors)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


SQL = """
with v as (select vec_id, embedding::double[] as v from embeddings),
u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from v where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
g as (select vec_id, list_transform(v, lambda x: x / l)::double[64] as v from u where l > 0),
e as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and array_inner_product(a.v, b.v) >= 0.95),
r as (with recursive reach as (select vec_id as x, vec_id as y from embeddings union select reach.x, e.b from reach join e on reach.y = e.a) select x, min(y) as c from reach group by x),
n as (select a, count(*) as n from e group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from embeddings join r on r.x = vec_id left join n on n.a = vec_id
"""
