"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import node_of, shingle_sets
from .kernel import as_long, mix, pieces
from .langid import held_out, letter_codes
from .shared import arrow, attach, cut, drop

#: n-gram lengths, the bound on sampled labelled texts of each class, the bound on features, the least z of a kept one, smoothing and L2 penalty.
SIZES, SAMPLE, FEATURES, LEAST_Z, ALPHA, PENALTY = (4, 5, 6), 4000, 1 << 14, 2.5, 0.5, 2.0
#: The largest number of labels whose ids are broadcast, so that only labelled texts are hashed.
BROADCAST = 2_000_000
#: Entries (a text, a feature of it) in a block of the fit.
ENTRIES = 1 << 20
KIND = "struct<score:double,predicted:int>"
_BITS = 22


def ngrams(text: str, sizes=SIZES) -> np.ndarray:
    """64-bit hashes of the letter n-grams of a text; whatever isn't a letter counts as one space, as do both ends."""
    codes = letter_codes(text).astype(np.uint64)
    h, n, out = codes, 1, []
    while n < max(sizes) and len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n:]
        n += 1
        if n in sizes:
            out.append(mix(h + np.uint64(n)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Model:
    """Feature hashes (ascending), the weight of each (classifier weight times log-count ratio), and the bias."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weight, self.bias = keys[order], weight[order], bias
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def present(self, text: str) -> np.ndarray:
        """Features that a text holds, each once."""
        h = ngrams(text)
        h = np.unique(h[self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]])
        if not len(h) or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at[self.keys[at] == h]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.present(text or "")].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(at: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on binary features scaled by their ratios, by accelerated gradient steps; the bias isn't penalised.

    ``col`` holds the texts' features, text i those of at[i]:at[i + 1]. Texts
    are met in blocks of about ``ENTRIES``, so that nothing but ``col`` itself
    is as long as the entries.
    """
    size, n = len(ratio), np.diff(at)
    cut_at = np.unique(np.concatenate([np.searchsorted(at, np.arange(0, at[-1], ENTRIES)), [len(y)]]))
    blocks = list(zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True))

    def by_text(u):
        return np.concatenate([np.zeros(0), *(np.bincount(np.repeat(np.arange(z - a), n[a:z]), u[col[at[a] : at[z]]], z - a) for a, z in blocks)])

    def by_feature(g):
        out = np.zeros(size)
        for a, z in blocks:
            out += np.bincount(col[at[a] : at[z]], np.repeat(g[a:z], n[a:z]), size)
        return out

    w, b = np.zeros(size), float(np.log((weight[y == 1].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9)))
    # the step is one over a bound of the Hessian's largest eigenvalue: its greatest row sum
    row = by_text(np.abs(ratio)) + 1
    most = max((np.abs(ratio) * by_feature(weight * row)).max(initial=0.0), float((weight * row).sum()))
    step = 1 / (0.25 * most + penalty)
    vw, vb, was_w, was_b, t = w, b, w, b, 1.0
    for _ in range(rounds):
        z = by_text(vw * ratio) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w, b = vw - step * (ratio * by_feature(g) + penalty * vw), vb - step * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, was_w, was_b, t = w + (t - 1) / s * (w - was_w), b + (t - 1) / s * (b - was_b), w, b, s
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, text_col="text", id_col="doc_id", label_id="doc_id", label_col="toxic", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most ``sample`` labelled texts of each class, those of least id hash; texts of equal shingle sets count once.

    Labels without a text and copies are left out before the sample is taken, so
    they take up no place in it.

    Labels must already be limited to what may be learned from. An id with
    several labels takes the greatest, an id on several rows the text of least hash.
    Classes weigh as in all labels. Without labels of both classes, or where
    no n-gram tells them apart, every score is the share of toxic labels.
    """
    lab = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    size = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if len(size) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not total else (30.0 if 1 in size else -30.0))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ours = texts.join(F.broadcast(lab.select("id")), "id", "left_semi") if total <= BROADCAST else texts

    def named(batches):
        for b in batches:
            for p in pieces(b, 2):
                n = [node_of(s) if len(s) else None for s in shingle_sets(p.column(2))]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(n, pa.int64())], names=["id", "h", "node"])

    names = arrow(ours.select("id", "h", "text"), named, f"id {dict(texts.dtypes)['id']}, h long, node long").groupBy("id").agg(F.min(F.struct("h", "node")).alias("s"))
    order = F.struct(F.xxhash64(F.lit(11), "id").alias("o"), "id", F.col("s.h").alias("h"))
    folded = cut(names.join(lab, "id").groupBy("y", F.col("s.node").alias("node")).agg(F.min(order).alias("first")).select("y", "first.*"), "folded")
    picked = [folded.where(F.col("y") == y).orderBy("o", "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]).select("id", "h", "y"))  # two times ``sample`` rows of three numbers at most
    once = texts.join(few, ["id", "h"]).groupBy("id", "y").agg(F.min("text").alias("text"))
    kept = cut(once.select("y", "text"), "labelled")

    def grams(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = as_long(np.unique(ngrams(t)))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), y, np.int32))], names=["g", "y"])

    have = {r.y: r.n for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    plain = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((size[1] + 0.5) / (size[0] + 0.5))))
    if len(have) < 2:
        return plain
    count = arrow(kept, grams, "g long, y int").groupBy("g").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    count = count.where("n > 2").select("g", (F.col("p") + ALPHA).alias("p"), (F.col("n") - F.col("p") + ALPHA).alias("q"))
    count = count.withColumn("r", F.log(F.col("p") / (have[1] + 2 * ALPHA)) - F.log(F.col("q") / (have[0] + 2 * ALPHA))).withColumn("z", F.abs("r") / F.sqrt(1 / F.col("p") + 1 / F.col("q")))
    best = count.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "g").limit(features).select("g", "r").toPandas()
    if not len(best):
        return plain
    keys, ratio = best["g"].to_numpy(np.int64).view(np.uint64), best["r"].to_numpy(float)
    blank = Model(keys, ratio, 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(blank)

    def held(batches):
        for b in batches:
            got = [sent.value.present(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["y", "at"])

    got = arrow(kept, held, "y int, at array<int>").toArrow().combine_chunks()
    drop(kept, folded)
    sent.destroy()
    y, lists = got.column("y").to_numpy().astype(np.float32), got.column("at").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    share = np.where(y == 1, size[1] / total * len(y) / have[1], size[0] / total * len(y) / have[0])
    w, b = fit(at - at[0], lists.flatten().to_numpy(), y, share, blank.weight)
    return Model(blank.keys, w * blank.weight, b)


def score(docs: DataFrame, model: Model, text_col="text", keep=None, name="found") -> DataFrame:
    """docs with a struct of ``KIND`` from each whole text; null and empty texts score as texts without any feature."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def f(col):
            s = np.array([m.score(t) for t in col.to_pylist()], float)
            return pa.StructArray.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["score", "predicted"])

        return f

    return attach(docs, text_col, make, KIND, keep, name)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(5, 0)))
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "found.score", "found.predicted")
