"""Embedders, pair scorers, generators and judges by the names in the settings. A name that isn't registered is an error, and so is a setting that a model can't follow."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions import embed
from ..functions import text as T
from ..operators import answers, fitting, retrieval
from .config import Config, Llm

_made: dict[str, dict[str, Callable]] = {"embedder": {}, "scorer": {}, "generator": {}, "judge": {}}


def register(kind: str, name: str, make: Callable) -> None:
    """Register a model. Embedders and scorers: ``make(name)`` gives a function of Columns; generators ("provider/model") and judges: ``make(llm)``, with the settings' Llm, a function from prompts to texts."""
    if kind not in _made:
        raise ValueError(f"unknown kind of model {kind!r}; known: {', '.join(_made)}")
    _made[kind][name] = make


def _get(kind: str, name: str) -> Callable:
    if name not in _made[kind]:
        raise ValueError(f"no {kind} {name!r} here: register it; known: {', '.join(sorted(_made[kind]))}")
    return _made[kind][name]


def embedder(cfg: Config):
    """hashed-N: signed feature hashing in N dimensions; else what is registered."""
    name = cfg.embedding.model_name
    if m := re.fullmatch(r"hashed-([1-9]\d*)", name):
        return lambda text: embed.hashed(text, int(m[1]))
    return _get("embedder", name)(name)


def scorer(cfg: Config, spark=None):
    """overlap: shared tokens; fitted:FOLDER: a scorer that ``fitting.Scorer.write`` left there; else what is registered. Reranking off needs none."""
    name = cfg.retriever.reranker_model
    if not cfg.retriever.reranker_enabled:
        return None
    if name == "overlap":
        return retrieval.overlap_score
    if name.startswith("fitted:"):
        from pyspark.sql import SparkSession

        return fitting.Scorer.load(spark or SparkSession.active(), name.removeprefix("fitted:")).score
    return _get("scorer", name)(name)


def _words(texts: list[str], most: int) -> list[str]:
    """Texts of at most ``most`` words."""
    out = []
    for t in texts:
        ends = [m.end() for m in re.finditer(r"\S+", t)]
        out.append(t if len(ends) <= most else t[: ends[most - 1]])
    return out


def _extractive(llm: Llm):
    if llm.temperature:
        raise ValueError("the offline generator has no temperature; set it to 0")
    return lambda prompts: _words(answers.extractive(prompts), llm.max_tokens)


def generator(cfg: Config):
    """offline/extractive: the first passage, cut at max_tokens words; else what is registered as "provider/model"."""
    if cfg.llm.max_tokens < 1:
        raise ValueError("max_tokens must be 1 or more")
    return _get("generator", f"{cfg.llm.provider}/{cfg.llm.model}")(cfg.llm)


def judge(cfg: Config):
    return _get("judge", cfg.llm.judge_model)(cfg.llm)


def tokens(cfg: Config):
    """(text to tokens, tokens to text) of the chunk strategies: words, or the pieces of a tokenizer file."""
    path = cfg.chunk.tokenizer
    if not path:
        return T.space_tokens, None
    if cfg.chunk.strategy == "header_aware" and cfg.chunk.header_min_section_tokens > 0:
        raise ValueError("sections are merged by words: set header_min_section_tokens to 0, or no tokenizer")
    sub = T.Subwords(path)
    return sub.tokens, sub.joined


def check(cfg: Config) -> None:
    """Raise where a setting names what isn't here. Run before any work."""
    embedder(cfg)
    generator(cfg)
    judge(cfg)
    tokens(cfg)
    if cfg.retriever.reranker_enabled and not cfg.retriever.reranker_model.startswith("fitted:"):
        scorer(cfg)


register("generator", "offline/extractive", _extractive)
register("judge", "token-overlap", lambda llm: answers.overlap_judge)
