"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix
from .shared import arrow, attach, cut

#: Hashed n-gram dimensions, n-gram lengths, centroids per language, and the bound on sampled training texts per language.
DIMS, SIZES, CLUSTERS, SAMPLE = 1 << 14, (1, 2, 3), 4, 400
#: A text whose nearest centroid is farther (1 - cosine) than this quantile of the training texts of its language, times SLACK, is rejected.
QUANTILE, SLACK = 0.995, 1.25
UNKNOWN = "und"
#: Languages whose counts are broadcast; with more they are joined by a shuffle.
LANGS = 10_000
KIND = "struct<lang_pred:string,score:double,distance:double,rejected:boolean>"

_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is none."""
    if not _table:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table.append(t)
    return _table[0]


def letter_codes(text: str) -> np.ndarray:
    """Letters in lower case, every run of other characters as one 0, and a 0 at either end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters()[raw]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    return np.concatenate([np.zeros(1, np.uint32), c[keep], np.zeros(1, np.uint32)])


def features(codes: np.ndarray, dims: int = DIMS, sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and their counts."""
    h, n = codes.astype(np.uint64), 1
    total = np.zeros(dims, np.int64)
    while True:
        if n in sizes:
            total += np.bincount((mix(h * np.uint64(31) + np.uint64(n)) & np.uint64(dims - 1)).astype(np.int64), minlength=dims)
        if n == max(sizes) or len(h) < 2:
            break
        h = h[:-1] * np.uint64(0x110001) + codes[n:]
        n += 1
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """idf, unit centroids (rows), their languages, and the distance beyond which each language rejects."""

    def __init__(self, idf, centroids, langs, limits):
        self.idf, self.centroids, self.langs, self.limits = idf, np.ascontiguousarray(centroids.T), list(langs), dict(limits)
        self.names = sorted(set(self.langs))
        self.owner = np.array([self.names.index(x) for x in self.langs], np.int64)

    def vector(self, text: str):
        at, n = features(letter_codes(text))
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / (np.sqrt((v * v).sum()) or 1.0)

    def predict(self, text: str | None):
        if not text or not self.langs:
            return UNKNOWN, 0.0, 1.0, True
        codes = letter_codes(text)
        if not codes.any():
            return UNKNOWN, 0.0, 1.0, True
        at, n = features(codes)
        v = (1 + np.log(n)) * self.idf[at]
        cos = (v @ self.centroids[at]) / (np.sqrt((v * v).sum()) or 1.0)
        best = np.full(len(self.names), -1.0)
        np.maximum.at(best, self.owner, cos)
        k = int(best.argmax())
        far = 1 - best[k]
        return self.names[k], float(min(1.0, max(0.0, best[k]))), float(far), bool(far > self.limits[self.names[k]])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit rows; the first centre is the mean, each next the row farthest from those before. Empty clusters go."""
    centres = [x.mean(0)]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[near.argmin()])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.stack([x[own == i].sum(0) for i in range(len(c)) if (own == i).any()])
        new /= np.maximum(np.sqrt((new * new).sum(1, keepdims=True)), 1e-12)
        if new.shape == c.shape and np.allclose(new, c):
            break
        c = new
    return c


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Fit on at most ``sample`` texts of each language, those of least hash; their whole texts are turned into n-gram counts on the executors."""
    few = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("h"))
    n = cut(few.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    if n.count() <= LANGS:  # a row for each language; with it on every task the texts that aren't sampled aren't shuffled
        n = F.broadcast(n)
    # about twice the wanted rows by their hash, then exactly the least ones: no window over the whole table
    few = few.join(n, "lang").where(F.expr(f"pmod(h, 1000003) <= 1000003D * {2 * sample + 50} / n"))
    few = few.selectExpr("lang", "text", "row_number() over (partition by lang order by h) as rn").where(F.col("rn") <= sample).select("lang", "text")

    def run(batches):
        for b in batches:
            got = [(lang, *features(letter_codes(t))) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if any(c.isalpha() for c in t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[2].astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["lang", "at", "n"])

    rows = arrow(few, run, "lang string, at array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r.lang, r.at, r.n))
    df = np.zeros(DIMS)
    for r in rows:
        df[r.at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    centroids, langs, limits = [np.zeros((0, DIMS))], [], {}
    for lang in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == lang]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, r in enumerate(own):
            v = (1 + np.log(np.array(r.n))) * idf[r.at]
            x[i, r.at] = v / np.sqrt((v * v).sum())
        c = cluster(x, clusters)
        centroids.append(c)
        langs += [lang] * len(c)
        limits[lang] = float(np.quantile(1 - (x @ c.T).max(1), QUANTILE)) * SLACK
    return Model(idf, np.concatenate(centroids), langs, limits)


def identify(docs: DataFrame, model: Model, text_col="text", keep=None, name="found") -> DataFrame:
    """docs with a struct of ``KIND`` from each whole text.

    lang_pred is the language of the nearest centroid, score its cosine,
    distance 1 less the cosine, rejected whether that is beyond the language's
    limit. Null texts and those without a letter are ``und`` with score 0 and
    rejected; so is everything where nothing could be learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def f(col):
            got = [m.predict(t) for t in col.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "distance", "rejected"])

        return f

    return attach(docs, text_col, make, KIND, keep, name)


def held_out(n: int, rest: int, id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == rest, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(4, 2)), "text", "lang", "doc_id")
    out = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
