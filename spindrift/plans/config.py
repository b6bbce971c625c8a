"""Settings of a corpus, its index and its evaluation. Unknown keys are errors."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Corpus:
    #: Where the search source is asked, and what stands before its links.
    search_api: str = ""
    base_url: str = ""
    link_prefix: str = ""
    published_after: str = "0000-01-01"
    published_before: str = "9999-12-31"
    max_articles: int = 200


@dataclass(frozen=True)
class Chunk:
    strategy: str = "fixed"
    size_tokens: int = 512
    overlap_tokens: int = 50
    child_size_tokens: int = 128
    child_overlap_tokens: int = 16
    header_min_section_tokens: int = 0
    semantic_breakpoint_percentile: float = 90.0
    #: A file of the tokenizers library, whose pieces are counted in place of words.
    tokenizer: str = ""


@dataclass(frozen=True)
class Embedding:
    model_name: str = "hashed-256"
    query_prefix: str = ""


@dataclass(frozen=True)
class Retriever:
    #: dense or hybrid; hybrid with small_to_big chunks returns children, as it fuses before any collapse.
    type: str = "dense"
    top_k: int = 5
    rrf_k: int = 60
    reranker_enabled: bool = False
    reranker_model: str = "overlap"
    rerank_top_n: int = 50


@dataclass(frozen=True)
class Llm:
    provider: str = "offline"
    model: str = "extractive"
    temperature: float = 0.0
    max_tokens: int = 800
    judge_model: str = "token-overlap"
    metadata_enabled: bool = False


@dataclass(frozen=True)
class Config:
    corpus: Corpus = field(default_factory=Corpus)
    chunk: Chunk = field(default_factory=Chunk)
    embedding: Embedding = field(default_factory=Embedding)
    retriever: Retriever = field(default_factory=Retriever)
    llm: Llm = field(default_factory=Llm)


def load(path: str) -> Config:
    """A YAML file of sections named as the fields of Config; absent ones keep their defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    parts = {x.name: x.default_factory for x in dataclasses.fields(Config)}
    if unknown := set(raw) - set(parts):
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return Config(**{k: parts[k](**(v or {})) for k, v in raw.items()})


def sweep(base: Config, section: str, **values) -> list[Config]:
    """One Config for each value of one setting: sweep(c, "chunk", size_tokens=[256, 512])."""
    (name, each), = values.items()
    return [dataclasses.replace(base, **{section: dataclasses.replace(getattr(base, section), **{name: v})}) for v in each]
