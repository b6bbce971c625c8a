"""Queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from .. import read
from . import codes, decontaminate, jaccard, langid, lines, lm, mixing, neardup, pieces, pii, repair, toxicity, trie


def table(spark, sf_dir: str, name: str):
    return read(spark, f"{sf_dir}/{name}.parquet")


def op1_language(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return pieces.count_report(table(spark, sf_dir, "documents"))


def op3_near_vectors(spark, sf_dir):
    return neardup.vector_report(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repair_tokens(spark, sf_dir):
    return repair.token_report(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


def op7_loss_difference(spark, sf_dir):
    return lm.loss_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark, sf_dir):
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return trie.trie_report(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark, sf_dir):
    return codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_token_counts, op3_near_vectors, op4_toxicity, op5_repair_tokens, op6_jaccard_join, op7_loss_difference, op8_decontaminate, op9_personal_data, op10_mixing, op11_prefix_trie, op12_vector_codes, op13_line_dedup, pipeline)}
ORACLES = {"op3_near_vectors": neardup.SQL, "op6_jaccard_join": jaccard.SQL, "op8_decontaminate": decontaminate.SQL, "op10_mixing": mixing.SQL, "op11_prefix_trie": trie.SQL, "op12_vector_codes": codes.SQL, "op13_line_dedup": lines.SQL}
