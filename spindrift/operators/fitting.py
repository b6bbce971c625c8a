"""A pair scorer fitted over the cluster: gradients are added up in the tasks, the best weights by validation are kept and written."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..tables import cut, drop
from .evaluation import average_precision
from ..functions.text import let
from .training import pair_array

MODEL = "weights array<double>, mean array<double>, scale array<double>, step int, precision double"


@dataclass
class Scorer:
    """A logistic model on ``training.pair_array``; ``weights`` end in the bias."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    step: int = 0
    precision: float = 0.0

    def score(self, question: str, text: str):
        """The probability that a text answers a question, for ``retrieval.rerank``; a Column that stays in the JVM."""
        return let(pair_array(question, text), lambda x: _probability(self, x))

    def write(self, spark: SparkSession, path: str) -> str:
        row = [(self.weights.tolist(), self.mean.tolist(), self.scale.tolist(), self.step, self.precision)]
        spark.createDataFrame(row, MODEL).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        """The scorer in a folder; FileNotFoundError where there is none."""
        from pyspark.errors import AnalysisException

        try:
            r = spark.read.schema(MODEL).parquet(path).first()
        except AnalysisException as e:
            raise FileNotFoundError(f"no scorer in {path}; train one first") from e
        return Scorer(np.array(r.weights), np.array(r.mean), np.array(r.scale), r.step, r.precision)


def _probability(m: Scorer, features):
    terms = [(F.element_at(features, i + 1) - float(m.mean[i])) / float(m.scale[i]) * float(m.weights[i]) for i in range(len(m.mean))]
    z = F.lit(float(m.weights[-1]))
    for t in terms:
        z = z + t
    return 1 / (1 + F.exp(-z))


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of the logistic loss' gradient by weight and bias, then of the loss, then the number of rows."""
    z = x @ w[:-1] + w[-1]
    e = 1 / (1 + np.exp(-z)) - y
    loss = np.logaddexp(0, z) - y * z
    return np.concatenate([x.T @ e, [e.sum(), loss.sum(), len(y)]])


def _summed(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """``gradient`` over all rows (x, y): each task adds up its own, a shuffle the tasks' by component."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        total = np.zeros(len(w) + 2)
        for b in batches:
            if b.num_rows:
                total += gradient(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy(), w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(len(w) + 2)
    for r in rows.select("x", "y").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    sent.destroy()
    return out


def rate(step: int, steps: int, top: float, warm: float) -> float:
    """Learning rate at a step from 0: up to ``top`` over the first part ``warm`` of the steps, then down to nothing, in straight lines."""
    up = max(1, math.ceil(steps * warm))
    return top * (step + 1) / up if step < up else top * (steps - step) / max(1, steps - up)


def fit(train: DataFrame, val: DataFrame, question: str, text: str, label: str = "label", steps: int = 40, every: int = 10, top: float = 0.3, warm: float = 0.1, decay: float = 0.01) -> tuple[Scorer, list[tuple[int, float, float]]]:
    """(the best scorer, reports): Adam steps with decoupled decay on the whole of train, judged on val every ``every`` steps by average precision (step, mean loss, precision).

    Rows without a label are left out; of equally good steps the first is kept;
    without rows in train the weights stay 0. The driver holds weights, tasks
    hold batches; each step reads the features written before the first.
    """
    spark = train.sparkSession
    ship(spark)

    def featured(rows):
        return cut(rows.where(F.col(label).isNotNull()).select(pair_array(question, text).alias("x"), F.col(label).cast("double").alias("y")), "features")

    a, b = featured(train), featured(val)
    d = F.size("x")
    size = a.agg(F.max(d).alias("d")).first().d or b.agg(F.max(d).alias("d")).first().d or 0
    flat = a.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    mean, scale = np.zeros(size), np.ones(size)
    for r in flat.collect():  # a row a feature
        mean[r.i], scale[r.i] = r.m, r.s or 1.0
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in scale])
    at = cut(a.select(F.transform("x", lambda v, i: (v - F.element_at(m, i + 1)) / F.element_at(s, i + 1)).alias("x"), "y"), "scaled")
    drop(a)
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    best, reports = None, []
    for step in range(steps + 1):
        total = _summed(at, w)
        n = max(1.0, total[-1])
        if step % every == 0 or step == steps:
            now = Scorer(w.copy(), mean, scale, step)
            now.precision = _precision(b, now)
            reports.append((step, total[-2] / n, now.precision))
            if best is None or now.precision > best.precision:
                best = now
        if step < steps and total[-1]:
            g = total[:-2] / n
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            lr = rate(step, steps, top, warm)
            held = np.append(np.ones(size), 0.0)  # the bias doesn't decay
            w = w - lr * (first / (1 - 0.9 ** (step + 1)) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8) + decay * held * w)
    drop(at, b)
    return best, reports


def _precision(rows: DataFrame, m: Scorer) -> float:
    """Average precision of the scores; equal scores go by the features, then unlike labels last first, so that it doesn't depend on the rows' order."""
    scored = rows.select(F.lit(0).alias("g"), F.struct("x", "y").alias("i"), F.round(_probability(m, F.col("x")), 9).alias("s"), F.col("y").cast("int").alias("l"))
    got = average_precision(scored, "g", "i", "s", "l").first()
    return float(got.average_precision) if got else 0.0
