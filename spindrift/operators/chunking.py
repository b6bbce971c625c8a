"""Chunking: windows over token arrays, sections, sentences and embeddings, as row expansion without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import cut
from .ranks import percentiles
from .scans import by_place, lookup, running


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Arrays of at most ``size`` tokens, starting every size - overlap (1 at least), up to the first that reaches the end."""
    return T.let(tokens, lambda t: _windows(t, size, max(1, size - overlap)))


def _windows(tokens: Column, size: int, stride: int) -> Column:
    n = F.size(tokens)
    k = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    at = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(tokens, i * stride + 1, size))


def _spaced(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def fixed(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50, tokens=T.space_tokens, joined=_spaced, keep: tuple = ()) -> DataFrame:
    """(id, keep..., chunk_no, chunk_id, text) of overlapping windows; empty windows are dropped, their numbers stay used.

    ``tokens`` and ``joined`` go from text to tokens and back, such as ``text.Subwords``.
    """
    out = docs.select(F.col(id_col).alias("id"), *keep, F.posexplode(windows(tokens(text_col), size, overlap)).alias("chunk_no", "w"))
    out = out.select("id", *keep, "chunk_no", F.concat_ws("::", F.col("id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), F.trim(joined(F.col("w"))).alias("text"))
    return out.where(F.trim("text") != "")


def small_to_big(docs: DataFrame, id_col: str, text_col: str, size: int = 512, child: int = 128, overlap: int = 16, tokens=T.space_tokens, joined=_spaced, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Parents without overlap and the overlapping children inside each."""
    parents = docs.select(F.col(id_col).alias("id"), *keep, F.posexplode(windows(tokens(text_col), size, 0)).alias("p", "w"))
    parents = parents.withColumn("parent_id", F.concat(F.col("id").cast("string"), F.lit("::p"), F.col("p").cast("string")))
    children = parents.select("id", *keep, "parent_id", F.posexplode(windows(F.col("w"), child, overlap)).alias("c", "v"))
    children = children.select("id", *keep, "parent_id", F.concat("parent_id", F.lit("::c"), F.col("c").cast("string")).alias("chunk_id"), joined(F.col("v")).alias("text"))
    return parents.select("id", *keep, "parent_id", joined(F.col("w")).alias("text")), children


def sentence_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.sentences(text_col)).alias("i", "sentence"))


def buffered(sents: Column, reach: int = 1) -> Column:
    """Each sentence joined with its neighbours up to ``reach`` away."""

    def near(s):
        first = lambda i: F.greatest(i + 1 - reach, F.lit(1))
        return F.transform(s, lambda x, i: F.array_join(F.slice(s, first(i), F.least(i + 1 + reach, F.size(s)) - first(i) + 1), " "))

    return T.let(sents, near)


def _neighbours(vectors: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """(group, order, _place, _before, gap): each unit vector's cosine distance to the one before it in its group, null for the first."""
    rows = running(vectors.select(group, order, vec), [group], [order], lags={"_before": F.col(order), "_vec": F.col(vec)}, place="_place")
    return rows.select(group, order, "_place", "_before", F.when(F.col("_vec").isNotNull(), 1 - T.dot(vec, "_vec")).alias("gap"))


def gaps(vectors: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """(group, order, gap): cosine distance of each unit vector to the next one of its group; none for the last. A group may hold most of the table."""
    return _neighbours(vectors, group, order, vec).where("gap is not null").select(group, F.col("_before").alias(order), "gap")


def thresholds(gap_rows: DataFrame, group: str, percent: float = 90.0) -> DataFrame:
    """(group, threshold): exact percentiles, no group in one row."""
    return percentiles(gap_rows, [group], "gap", {"threshold": percent / 100}).select(group, "threshold")


def semantic_groups(vectors: DataFrame, group: str, order: str, vec: str, percent: float = 90.0) -> DataFrame:
    """(group, order, part): a new part follows each gap strictly above the group's percentile."""
    near = cut(_neighbours(vectors, group, order, vec), "neighbours")
    wide = lookup(near, thresholds(near, group, percent), group, "left")
    wide = cut(wide.select(group, order, "_place", F.coalesce((F.col("gap") > F.col("threshold")).cast("int"), F.lit(0)).alias("_cut")), "wide")
    return by_place(wide, [group], "_place", {"part": F.col("_cut")}).select(group, order, "part")


def capped(chunks: DataFrame, text_col: str, size: int, overlap: int, tokens=T.space_tokens, joined=_spaced) -> DataFrame:
    """Texts of at most ``size`` tokens as they are, longer ones as windows; adds ``piece`` and ``text``."""
    keep = [c for c in chunks.columns if c != text_col]
    rows = chunks.select(*keep, F.col(text_col).alias("_whole"), tokens(text_col).alias("_t"))
    parts = F.when(F.size("_t") <= size, F.array(F.lit(None).cast("array<string>"))).otherwise(windows(F.col("_t"), size, overlap))
    rows = rows.select(*keep, "_whole", F.posexplode(parts).alias("piece", "_w"))
    return rows.select(*keep, "piece", F.when(F.col("_w").isNull(), F.col("_whole")).otherwise(joined(F.coalesce("_w", F.array().cast("array<string>")))).alias("text")).where(F.trim("text") != "")


def semantic(sents: DataFrame, group: str, order: str, text_col: str, vec: str, size: int = 512, overlap: int = 50, percent: float = 90.0, tokens=T.space_tokens, joined=_spaced) -> DataFrame:
    """Sentences with vectors to chunks: split at wide gaps, joined by spaces, long ones windowed. Chunks are numbered by (part, piece) within a group."""
    parts = semantic_groups(sents, group, order, vec, percent).join(sents.select(group, order, text_col), [group, order])
    whole = parts.groupBy(group, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col]), " ").alias("_text"))
    return capped(whole, "_text", size, overlap, tokens, joined)


def merge_small(sections: Column, floor: int, tokens=T.space_tokens) -> Column:
    """Sections below ``floor`` tokens joined to the one before, or carried to the next where there is none before."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("carry"))

    def step(acc, s):
        text = F.when(acc["carry"].isNull(), s).otherwise(F.concat(acc["carry"], F.lit("\n"), s))
        small = F.size(tokens(text)) < floor
        n = F.size(acc["out"])
        back = F.concat(F.slice(acc["out"], 1, n - 1), F.array(F.concat(F.element_at(acc["out"], n), F.lit("\n"), text)))
        return (
            F.when(small & (n > 0), F.struct(back.alias("out"), F.lit(None).cast("string").alias("carry")))
            .when(small, F.struct(acc["out"].alias("out"), text.alias("carry")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(text)).alias("out"), F.lit(None).cast("string").alias("carry")))
        )

    return F.aggregate(sections, start, step, lambda a: F.when(a["carry"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["carry"]))))


def section_stats(sectioned: DataFrame, id_col: str, group: str, sections_col: str, size: int = 512, overlap: int = 50, floor: int = 0, tokens=T.space_tokens) -> tuple[DataFrame, DataFrame]:
    """(by group, by article): articles, sections (after merging), chunks, and sections too long for one chunk."""
    s = F.col(sections_col) if floor <= 0 else merge_small(F.col(sections_col), floor, tokens)
    n = F.transform(s, lambda x: F.struct((F.size(tokens(x)) > size).alias("capped"), F.when(F.size(tokens(x)) > size, F.size(windows(tokens(x), size, overlap))).otherwise((F.trim(x) != "").cast("int")).alias("n")))
    each = sectioned.select(F.col(id_col), F.col(group), n.alias("_n")).select(id_col, group, F.size("_n").alias("n_sections"), F.aggregate("_n", F.lit(0), lambda a, x: a + x["n"]).alias("n_chunks"), F.size(F.filter("_n", lambda x: x["capped"])).alias("n_capped"))
    by = each.groupBy(group).agg(F.count("*").alias("n_articles"), *[F.sum(c).alias(c) for c in ("n_sections", "n_chunks", "n_capped")])
    return by, each


def header_aware(sectioned: DataFrame, id_col: str, sections_col: str, size: int = 512, overlap: int = 50, floor: int = 0, tokens=T.space_tokens, joined=_spaced) -> DataFrame:
    """Articles with an array of sections to chunks: small sections merged, long ones windowed, numbered in order."""
    s = F.col(sections_col) if floor <= 0 else merge_small(F.col(sections_col), floor)
    rows = sectioned.select(F.col(id_col).alias("id"), F.posexplode(s).alias("section", "_text"))
    out = capped(rows, "_text", size, overlap, tokens, joined)
    w = Window.partitionBy("id").orderBy("section", "piece")
    no = F.row_number().over(w) - 1
    return out.select("id", "section", F.concat_ws("::", F.col("id").cast("string"), no.cast("string")).alias("chunk_id"), "text")


def stats(docs: DataFrame, group: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Articles, chunks and articles cut up, by group."""
    n = F.size(windows(T.space_tokens(text_col), size, overlap))
    return docs.select(F.col(group), n.alias("n")).groupBy(group).agg(F.count("*").alias("n_articles"), F.sum("n").alias("n_chunks"), F.count_if(F.col("n") > 1).alias("n_capped"))


STRATEGIES = {"fixed": fixed, "small_to_big": small_to_big, "semantic": semantic, "header_aware": header_aware}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {name!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[name]
