"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import lookup
from .kernel import ALNUM, LOWER, grams, mix, strings, word_hashes, words
from .shared import arrow, attach, cut, drop, free

WINDOW = 10
#: Words of benchmark text in one broadcast; a larger benchmark is searched in several passes.
BLOCK = 500_000
KIND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hits:array<struct<first:int,last:int>>>"


def _plain(data: np.ndarray, starts, ends, a: int, b: int) -> bytes:
    return b" ".join(LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(a, b))


class Tables:
    """Shift and suffix tables of the patterns of one length of m words."""

    def __init__(self, m: int, rows: dict[bytes, tuple[np.ndarray, set[str]]]):
        self.m, self.b = m, min(2, m)
        self.plain = list(rows)
        self.items = [sorted(x[1]) for x in rows.values()]
        self.hashes = np.stack([x[0] for x in rows.values()])
        blocks = np.concatenate([grams(self.hashes[:, j : j + self.b].T.copy(), self.b)[0] for j in range(m - self.b + 1)])
        away = np.repeat(np.arange(m - self.b, -1, -1), len(rows))
        order = np.lexsort((away, blocks))
        blocks, away = blocks[order], away[order]
        first = np.concatenate([[True], blocks[1:] != blocks[:-1]])
        #: SHIFT: how far the nearest pattern end may be behind a block; blocks not held shift by a whole step.
        self.keys, self.shift = blocks[first], away[first]
        suffix = grams(self.hashes[:, m - self.b :].T.copy(), self.b)[0]
        #: HASH: patterns by their last block.
        self.by = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.by]

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of windows whose hashes agree. One scan starts at every step, all at once."""
        m, b = self.m, self.b
        step = m - b + 1
        pos = np.arange(m - 1, len(h) + step, step)
        stop = pos + step
        pos = np.minimum(pos, len(h) - 1)  # the last scan starts at the last word
        ends, pats = [], []
        if len(h) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(pos):
            blk = h[pos][None] if b == 1 else np.stack([h[pos - 1], h[pos]])
            blk = grams(blk, b)[0]
            at = np.minimum(np.searchsorted(self.keys, blk), len(self.keys) - 1)
            on = self.keys[at] == blk
            pos, stop, blk, sh = pos[on], stop[on], blk[on], self.shift[at[on]]
            zero = sh == 0
            if zero.any():
                lo, hi = np.searchsorted(self.suffix, blk[zero]), np.searchsorted(self.suffix, blk[zero], "right")
                n = hi - lo
                e = np.repeat(pos[zero], n)
                p = self.by[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                ok = e >= m - 1
                e, p = e[ok], p[ok]
                for j in range(m - 1, -1, -1):
                    ok = h[e - (m - 1 - j)] == self.hashes[p, j]
                    e, p = e[ok], p[ok]
                ends.append(e)
                pats.append(p)
            pos = pos + np.maximum(sh, 1)
            on = (pos < stop) & (pos < len(h))
            pos, stop = pos[on], stop[on]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(ends), np.concatenate(pats)]), axis=1)
        return both[0], both[1]


def compile_patterns(texts: list[tuple[str, str]], window: int = WINDOW) -> list[Tables]:
    """(item, text) rows to tables by window length. Items without words give none."""
    by: dict[int, dict] = {}
    for item, text in texts:
        data, bounds = strings(pa.array([text], pa.string()))
        starts, ends, _ = words(data, bounds, ALNUM)
        if not len(starts):
            continue
        h, m = word_hashes(data, starts, ends), min(window, len(starts))
        for i in range(len(starts) - m + 1):
            key = _plain(data, starts, ends, i, i + m)
            by.setdefault(m, {}).setdefault(key, (h[i : i + m], set()))[1].add(item)
    return [Tables(m, rows) for m, rows in sorted(by.items())]


def scan(col: pa.Array, tables: list[Tables]) -> pa.Array:
    """The struct ``KIND`` of each text."""
    data, bounds = strings(col)
    starts, ends, wb = words(data, bounds, ALNUM)
    h = word_hashes(data, starts, ends)
    cover = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set] = {}
    for t in tables:
        e, p = t.search(h)
        doc = np.searchsorted(wb, e, "right") - 1
        ok = e - t.m + 1 >= wb[doc]
        for x, k, d in zip(e[ok].tolist(), p[ok].tolist(), doc[ok].tolist(), strict=True):
            if _plain(data, starts, ends, x - t.m + 1, x + 1) == t.plain[k]:
                cover[x - t.m + 1] += 1
                cover[x + 1] -= 1
                items.setdefault(d, set()).update(t.items[k])
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n = len(col)
    spans: list = [[] for _ in range(n)]
    for d in items:
        x = np.flatnonzero(np.diff(np.concatenate([[0], hit[wb[d] : wb[d + 1]].astype(np.int8), [0]])))
        spans[d] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(x[::2], x[1::2], strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(wb)), pa.array(total[wb[1:]] - total[wb[:-1]]), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
        names=["n_words", "n_hit", "items", "hits"],
    )


def _merged(each: list[dict]) -> dict:
    """A text's results from several blocks of patterns as one."""
    out: list = []
    for a, b in sorted((x["first"], x["last"]) for r in each for x in r["hits"]):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return {"n_words": each[0]["n_words"], "n_hit": sum(x["last"] - x["first"] + 1 for x in out), "items": sorted({i for r in each for i in r["items"]}), "hits": out}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", window: int = WINDOW, block: int = BLOCK, keep=None, name="found") -> DataFrame:
    """docs with a struct of ``KIND``: words, words inside any occurrence of a benchmark window, items found, runs of hit words.

    Null and empty texts have no words and no hits; items without words match
    nothing; repeated items count once each; an empty benchmark hits nothing.
    Benchmark text is met in blocks of about ``block`` words, of which the
    driver and a task hold one. One block is one narrow pass. With several, each
    reads the texts and writes the hits of the texts that have some, under a
    digest of the text; the last step joins them to the documents, so texts are
    never written and shuffled once at most.
    """
    sent, parts = None, []
    for tables, last in _blocks(benchmark, item_col, item_text, window, block):
        sent = docs.sparkSession.sparkContext.broadcast(tables)

        def make(sent=sent):
            return lambda col: scan(col, sent.value)

        if last and not parts:
            return attach(docs, text_col, make, KIND, keep, name)
        digest = docs.select(F.md5(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))
        found = attach(digest, "text", make, KIND, ["key"], "found").where("found.n_hit > 0")
        parts.append(cut(found.groupBy("key").agg(F.first("found").alias("found")), "hits"))
        sent.destroy()
    return _joined(docs, parts, text_col, keep, name)


def _joined(docs: DataFrame, parts: list[DataFrame], text_col: str, keep, name: str) -> DataFrame:
    """docs with the hits of several blocks, (key, found) by digest of the text, merged; texts without any have their words counted."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    gathered = every.groupBy("key").agg(F.collect_list("found").alias("all"))

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hits", kind)])
        for b in batches:
            rows = [_merged(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["key", "found"])

    merged = cut(arrow(gathered, run, f"key string, found {KIND}"), "hits")
    drop(*parts)
    keep = docs.columns if keep is None else keep
    name = free(keep, name)
    key, words = free([*keep, name], "_key_"), free([*keep, name], "_words_")
    n = F.coalesce(F.expr(rf"regexp_count(`{text_col}`, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"), F.lit(0)).cast("long")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.md5(F.col(f"`{text_col}`")).alias(key), n.alias(words))
    out = lookup(src, merged.toDF(key, name), key, "left")
    none = F.struct(F.col(words).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:int,last:int>>").alias("hits"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(name), none).alias(name))


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, window: int, block: int):
    """Compiled patterns of about ``block`` words of benchmark text each, one block at a time, and whether it is the last."""
    now, size = [], 0
    for item, text in benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("string"), item_text).toLocalIterator():
        if size >= block:
            yield compile_patterns(now, window), False
            now, size = [], 0
        now.append((item or "", text))
        size += len(text.split())
    yield compile_patterns(now, window), True


def decontaminate_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    sha = F.sha2(F.concat_ws(",", F.array_sort("found.items")), 256)
    return decontaminate(docs, benchmark, keep=["doc_id"]).select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bp as (select item_id, w, least(10, len(w)) as m, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from bw where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i + 1 : i + m], ' ') as g from bp),
lens as (select distinct m from win),
dp as (select doc_id, w, m, unnest(range(0, len(w) - m + 1)) as i from dw, lens where len(w) >= m),
dg as (select doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') as g from dp),
hit as (select doc_id, dg.m, i, item_id from dg join win on dg.m = win.m and dg.g = win.g),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x collate "C") as s from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""
