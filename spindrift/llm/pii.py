"""Personal data: exact base patterns, and bootstrapped contextual extraction of what they miss.

The base spans are seeds. The words around a seed induce lexical patterns; the
patterns' other instances (mail-like words and digit chains that no base span
covers) are trusted as far as the patterns are, and the patterns as far as their
instances are, in a few rounds over the pattern-instance graph in Spark. What a
trusted pattern finds then becomes a span of the pattern's kind.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, cut

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, least summed trust of a pattern's instances, least share of them, least trust of a new instance.
ROUNDS, SUPPORT, SHARE, TRUST = 3, 3.0, 0.6, 0.8
KIND = "struct<base:array<struct<start:bigint,k:int,end:bigint>>,seeds:array<struct<k:int,start:bigint,end:bigint,inst:string,pats:array<string>>>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A chain of digits can only begin a match at its first digit, so the others needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHAIN = re.compile(r"\(?[0-9][0-9().\x20-]*[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile("[0-9]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and apart, found from their @ in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns that hold, by start and kind."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def others(text: str, base: list) -> list[tuple[int, int]]:
    """Whole words with an @ inside and chains of 7 to 19 digits that touch no base span."""
    found = []
    at = text.find("@")
    while at >= 0:
        a = z = at
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        z = m.start() if (m := _SPACE.search(text, at)) else len(text)
        if z - a > 4:
            found.append((a, z))
        at = text.find("@", z + 1)
    if _DIGITS.search(text):
        found += [m.span() for m in _CHAIN.finditer(text) if m.end() - m.start() >= 7 and 7 <= sum(c.isdigit() for c in m.group()) <= 19]
    held, at, out = sorted(base), 0, []
    for a, z in sorted(found):
        while at < len(held) and held[at][2] <= a:
            at += 1
        if at == len(held) or held[at][0] >= z:
            out.append((a, z))
    return out


def contexts(words: tuple, a: int, z: int) -> list[str]:
    """Lexical patterns around a span, from the text's words (starts, ends, lower-cased): one and two words before, one before with one after, at any distance."""
    starts, ends, names = words
    left, right = bisect.bisect_right(ends, a) - 1, bisect.bisect_left(starts, z)
    if left < 0:
        return []
    out = ["1 " + names[left]]
    if left:
        out.append(f"2 {names[left - 1]} {names[left]}")
    if right < len(names):
        out.append(f"b {names[left]} {names[right]}")
    return out


def _find():
    def f(col):
        base, seeds = [], []
        for t in col.to_pylist():
            t = t or ""
            b = base_spans(t)
            base.append([{"start": a, "k": k, "end": z} for a, k, z in b])
            rows = [(k, a, z) for a, k, z in b] + [(-1, a, z) for a, z in others(t, b)]
            words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(t)] if rows else []
            words = tuple(zip(*words, strict=True)) if words else ((), (), ())
            seeds.append([{"k": k, "start": a, "end": z, "inst": re.sub(r"[\s().-]", "", t[a:z].lower()), "pats": contexts(words, a, z)} for k, a, z in rows])
        kind = [pa.list_(pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64())])), pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("inst", pa.string()), ("pats", pa.list_(pa.string()))]))]
        return pa.StructArray.from_arrays([pa.array(base, kind[0]), pa.array(seeds, kind[1])], names=["base", "seeds"])

    return f


def bootstrap(spots: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, share: float = SHARE, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """From occurrences (k, inst, pats), k -1 where unknown: trusted patterns (pat, k, trust) and instances (inst, k, trust).

    A pattern's trust in a kind is the summed trust of its distinct instances
    over their number plus one; a new instance's trust is 1 - prod(1 - trust of
    the accepted patterns that hold it). Seeds keep trust 1 in their kind.
    """
    edges = cut(spots.select("k", "inst", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.max("k").alias("k")), "graph")
    seeds = edges.where("k >= 0").select("inst", "k").distinct().withColumn("trust", F.lit(1.0))
    size = edges.groupBy("pat").agg(F.count("*").alias("n"))
    new = pats = None
    for _ in range(rounds):
        known = seeds if new is None else seeds.unionByName(new)
        held = edges.select("pat", "inst").join(known, "inst").groupBy("pat", "k").agg(F.sum("trust").alias("s"))
        pats = cut(held.where(F.col("s") >= support).join(size, "pat").withColumn("trust", F.col("s") / (F.col("n") + 1)).where(F.col("trust") >= share).select("pat", "k", "trust"), "patterns")
        got = edges.where("k < 0").select("pat", "inst").join(pats, "pat").groupBy("inst", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))).alias("trust"))
        new = cut(got.where(_fits()), "instances")
    return pats, new.where(F.col("trust") >= trust)


def _fits():
    """Whether an instance can be of kind k: mail-like words only as email, chains of digits only as the others."""
    mail, n = F.contains("inst", F.lit("@")), F.length(F.regexp_replace("inst", "[^0-9]", ""))
    return F.when(F.col("k") == 0, mail).when(F.col("k") == 2, ~mail & (n >= 12)).when(F.col("k") == 3, ~mail & (n <= 15)).otherwise(~mail & (n <= 12))


def find_personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, base, spans) for each row: arrays of (start, kind number, end) by start and kind, offsets in code points.

    ``base`` has the base patterns' spans, ``spans`` also those that the trusted
    patterns add (of several kinds the most trusted). Null texts count as empty;
    rows that repeat come back as often; empty tables give none.
    """
    rows = attach(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), text_col="text", make=_find, kind=KIND, keep=["id"], name="s")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "s.base", "s.seeds"), "spans")
    spots = rows.select("row", F.explode("seeds").alias("o")).select("row", "o.*")
    _, found = bootstrap(spots)
    best = found.groupBy("inst").agg(F.max_by("k", F.struct("trust", (-F.col("k")).alias("x"))).alias("kind"))
    more = spots.where("k < 0").join(best, "inst").groupBy("row").agg(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end")).alias("more"))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    return rows.join(more, "row", "left").select("id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _joined(col):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    out = find_personal_data(docs)

    def number(k):
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")

    n = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
