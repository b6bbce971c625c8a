"""A corpus from documents to token shards: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift import read
from spindrift.llm import decontaminate, jaccard, langid, mixing, repair, shared, toxicity


def _without(docs, found, bad):
    """The rows of docs without those for which the condition ``bad`` holds of the struct that ``found`` added."""
    name = shared.free(docs.columns, "_found_")
    return found.where(~F.coalesce(bad(F.col(f"`{name}`")), F.lit(False))).drop(name)


def reject_toxic(spark, docs, sf_dir):
    """Drop documents that the classifier marks as toxic; it learns from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~langid.held_out(5, 0)))
    found = toxicity.score(docs, model, name="_found_")
    return _without(docs, found, lambda x: x["predicted"] == 1)


def one_of_each_group(spark, docs, sf_dir):
    """Keep the document of the least id of each group of near copies."""
    return jaccard.keep_one(docs)


def remove_benchmark(spark, docs, sf_dir):
    """Drop documents in which a window of the benchmark occurs."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="_found_")
    return _without(docs, found, lambda x: x["n_hit"] > 0)


def mix_sources(spark, docs, sf_dir):
    """Repeat documents by their source's rate."""
    return mixing.mix(docs)


def token_shards(spark, docs, sf_dir):
    """Write token ids as compressed shards and read them back."""
    return repair.token_report(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_output", token_shards),
]

#: A trained classifier and a tokenizer can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
