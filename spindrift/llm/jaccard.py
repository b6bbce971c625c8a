"""N-gram Jaccard join by signature trees: all documents whose word-shingle sets agree by three quarters.

Each distinct shingle set is filed under its ``ROUTES`` least shingle hashes.
Two sets of Jaccard similarity J agree in one of them but for a chance below
(1 - J)**ROUTES, 6e-8 at the threshold (none for sets of up to 44 shingles).
The sets filed under one hash form a signature tree: nodes hold the OR of their
sets' bitmaps and the range of their sizes, and a dual traversal prunes pairs of
nodes whose greatest possible overlap is too small. What it can't prune is
checked on the whole sets. Groups are met in blocks, so no task holds a hot one;
sets already known to be connected aren't compared again, so a group of copies
costs about a row per copy and not one per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import lookup
from .kernel import SPACED, as_long, grams, mix, pieces, strings, word_hashes, words
from .shared import arrow, attach, components, cut, drop

WORDS = 5
#: Jaccard of at least NUM / DEN.
NUM, DEN = 3, 4
ROUTES = 12
#: Hashes used in the first round, sets of one hash in a block, partners a set offers in a block in the first round and growth per round.
EARLY, BLOCK, OFFER, MORE = 3, 2048, 4, 64
#: Bits of a signature per set member, at least.
DENSITY = 8
LEAF = 8
SKETCH = "struct<n:bigint,node:bigint,routes:array<bigint>,sig:binary>"


def shingle_sets(col: pa.Array, n: int = WORDS):
    """The ascending distinct shingle hashes of each text: none without words, one of all words below n words."""
    data, bounds = strings(col)
    starts, ends, at = words(data, bounds, SPACED)
    h = word_hashes(data, starts, ends)
    g = grams(h, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(g[a : b - n + 1]) if b - a >= n else grams(h[a:b], b - a) if b > a else h[:0]


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int(as_long(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)))[0])


def signature(s: np.ndarray) -> bytes:
    """A bitmap of at least ``DENSITY`` bits for each member of the set, a power of two."""
    width = max(64, 1 << (DENSITY * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sketches(routes: int, n: int):
    def make():
        def f(col):
            size, node, least, sig = [], [], [], []
            for s in shingle_sets(col, n):
                size.append(len(s))
                node.append(node_of(s) if len(s) else None)
                least.append(as_long(s[:routes]))
                sig.append(signature(s) if len(s) else None)
            return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["n", "node", "routes", "sig"])

        return f

    return make


def fold(sig: int, width: int, to: int) -> int:
    """The bitmap at a smaller width."""
    while width > to:
        width //= 2
        sig = (sig >> width) | (sig & ((1 << width) - 1))
    return sig


class Tree:
    """A node over sets[a:b] (name, size, label, width, bitmap, routes), which stand by size."""

    __slots__ = ("a", "b", "high", "kids", "label", "low", "sig", "slack", "width")

    def __init__(self, sets: list, a: int, b: int):
        self.a, self.b = a, b
        self.low, self.high = sets[a][1], sets[b - 1][1]
        self.width = sets[a][3]  # sizes ascend and so do widths
        own = [fold(s[4], s[3], self.width) for s in sets[a:b]]
        #: How many members of one set can share bits with others of it.
        self.slack = max(s[1] - x.bit_count() for s, x in zip(sets[a:b], own, strict=True))
        self.sig = 0
        for x in own:
            self.sig |= x
        labels = {s[2] for s in sets[a:b]}
        self.label = labels.pop() if len(labels) == 1 else None
        step = LEAF
        while step * LEAF < b - a:
            step *= LEAF
        self.kids = [] if b - a <= LEAF else [Tree(sets, i, min(b, i + step)) for i in range(a, b, step)]

    def apart(self, o: Tree) -> bool:
        """Whether no set here can reach the threshold with one there, or all are connected already."""
        if self.label is not None and self.label == o.label:
            return True
        if self.high * DEN < o.low * NUM or o.high * DEN < self.low * NUM:
            return True
        most = min(self.high, o.high)
        if self.width == o.width:
            most = min(most, (self.sig & o.sig).bit_count() + min(self.slack, o.slack))
        return most * (NUM + DEN) < NUM * (self.low + o.low)


def possible(x, y) -> bool:
    """Whether two sets can reach the threshold, by their sizes and bitmaps."""
    nx, ny = x[1], y[1]
    need = NUM * (nx + ny)
    if min(nx, ny) * (NUM + DEN) < need:
        return False
    w = min(x[3], y[3])
    p, q = fold(x[4], x[3], w), fold(y[4], y[3], w)
    both = (p & q).bit_count()
    return min(nx - p.bit_count() + both, ny - q.bit_count() + both) * (NUM + DEN) >= need


def tree_pairs(left: list, right: list | None, offer: int, route: int | None = None):
    """Candidate pairs of names among sets (right None) or between two blocks, and names that had more than ``offer``.

    With a route, only pairs that have no lesser route in common: the others are met there.
    """
    left.sort(key=lambda s: (s[1], s[4]))
    if right is not None:
        right.sort(key=lambda s: (s[1], s[4]))
    other = left if right is None else right
    if not left or not other or len(other) < 2 and right is None:
        return [], set()
    given: dict[int, int] = {}
    out, full = [], set()
    p = Tree(left, 0, len(left))
    stack = [(p, p if right is None else Tree(right, 0, len(right)))]
    while stack:
        a, b = stack.pop()
        if right is None and a is b:
            if a.label is not None:
                continue
        elif a.apart(b):
            continue
        if a.kids or b.kids:
            if right is None and a is b:
                stack += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
            elif a.kids and (not b.kids or a.b - a.a >= b.b - b.a):
                stack += [(x, b) for x in a.kids]
            else:
                stack += [(a, y) for y in b.kids]
            continue
        for i in range(a.a, a.b):
            x = left[i]
            for j in range(i + 1 if a is b else b.a, b.b):
                y = other[j]
                if x[2] == y[2] or x[0] == y[0] or not possible(x, y):
                    continue
                if route is not None and next(r for r in x[5] if r in y[5]) != route:
                    continue
                if given.get(x[0], 0) >= offer and given.get(y[0], 0) >= offer:
                    full.add(x[0])
                    break
                given[x[0]], given[y[0]] = given.get(x[0], 0) + 1, given.get(y[0], 0) + 1
                out.append((min(x[0], y[0]), max(x[0], y[0])))
    return out, full


def _traverse(rows: DataFrame, offer: int, once: bool) -> DataFrame:
    """(a, b) candidates from rows (route, i, j, block, node, n, label, sig, routes), ``once`` each; a = b says that a has more."""

    def run(batches):
        key, left, right = None, [], []

        def flush():
            got, full = tree_pairs(left, None if key[1] == key[2] else right, offer, key[0] if once else None)
            return [*got, *((x, x) for x in full)]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        out: list = []
        for b in batches:
            for route, i, j, own, node, n, label, sig, routes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (route, i, j):
                    if key and len(left) + len(right) > 1:
                        out += flush()
                        if len(out) > 50_000:
                            yield batch(out)
                            out = []
                    key, left, right = (route, i, j), [], []
                (left if own == i else right).append((node, n, label, len(sig) * 8, int.from_bytes(sig, "little"), routes))
        if key and len(left) + len(right) > 1:
            out += flush()
        yield batch(out)

    return arrow(rows.repartition("route", "i", "j").sortWithinPartitions("route", "i", "j").select("route", "i", "j", "block", "node", "n", "label", "sig", "routes"), run, "a long, b long")


def _bloom(ids: DataFrame, least: int = 20, most: int = 28):
    """A Bloom filter over a long column, in two probes, of 16 bits an id up to 32 MB (beyond, more pass; none is lost)."""
    bits = min(most, max(least, (16 * ids.count()).bit_length()))
    h = F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))))
    at = ids.select(h.alias("h")).select(F.expr(f"h & {(1 << bits) - 1}").alias("p"))
    got = at.groupBy(F.expr("p >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out), bits


def _sets(docs: DataFrame, ids: DataFrame, n: int):
    """(node, set) of the documents with these ids, and of few others, and the broadcast filter, to be destroyed when they are written. Texts aren't shuffled."""
    filt, bits = _bloom(ids)

    def run(batches):
        table = filt.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for k in (1, 2):
                p = b.column(k).to_numpy() & ((1 << bits) - 1)
                keep &= (table[p >> 6] >> (p & 63) & 1).astype(bool)
            b = b.filter(pa.array(keep))
            for x in pieces(b, 0):
                s = [s for s in shingle_sets(x.column(0), n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(v) for v in s], pa.int64()), pa.array([as_long(v) for v in s], pa.list_(pa.int64()))], names=["node", "set"])

    return arrow(docs.select("text", F.xxhash64("id"), F.xxhash64("id", F.lit(1))), run, "node long, set array<bigint>"), filt


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.join(used, "node", "left_semi").select(F.col("low").alias("id"))
    found, filt = _sets(docs, ids, n)
    sets = cut(found.groupBy("node").agg(F.first("set").alias("set")), "sets")
    filt.destroy()
    both = pairs.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b")
    ok = F.size(F.array_intersect("p", "q")) * (NUM + DEN) >= NUM * (F.size("p") + F.size("q"))
    out = cut(both.where(ok).select("a", "b"), "links")
    drop(sets)
    return out


def jaccard_groups(docs: DataFrame, id_col="doc_id", text_col="text", words_in: int = WORDS, routes: int = ROUTES) -> DataFrame:
    """(id, text_hash, n_shingles, component, group) for each row of docs; component is the least id it reaches over links.

    group names the connected sets themselves (null without shingles): unlike
    groups differ in it even where null or repeated ids give them one component.

    Null and empty texts, and texts without words, have no shingles, link with
    nothing and are components of their own; equal sets always link; rows that
    repeat come back as often as they occur, null ids under a null component
    unless another member has an id; empty tables give none.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    sketch = cut(attach(src, "text", _sketches(routes, words_in), SKETCH, ["id", "text_hash"], "s").select("id", "text_hash", "s.*"), "sketch")
    nodes = cut(sketch.where("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("routes").alias("routes"), F.first("sig").alias("sig")), "nodes")
    named = src.select("id", "text")
    tried = links = labels = None
    step, offer = 0, OFFER
    while True:
        own = nodes.select("node", "n", "sig", "routes")
        own = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else own.withColumn("label", F.col("node"))
        filed = own.select("node", "label", F.explode(F.slice("routes", 1, EARLY) if step == 0 else F.col("routes")).alias("route"))
        hot = filed.groupBy("route").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("c > 1 and x <> y").select("route", "c")
        filed = filed.join(hot, "route").withColumn("k", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(step)), F.col("k")).cast("int"))
        filed = filed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("route", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node")
        found = cut(_traverse(filed.join(own, "node"), offer, step > 0).distinct(), "pairs")
        more = found.where("a = b").limit(1).count() > 0
        pairs = found.where("a <> b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        new = cut(pairs, "new")
        drop(found)
        if new.limit(1).count():
            got = _verify(new, nodes, named, words_in)
            links = got if links is None else cut(links.unionByName(got), "links")
            labels = components(links)
            tried = new if tried is None else tried.unionByName(new)
        if step and not more:
            break
        step, offer = step + 1, offer * MORE
    whole = nodes.select("node", "low")
    if labels is not None:
        least = labels.join(whole, "node").groupBy("label").agg(F.min("low").alias("least"))
        whole = whole.join(labels.join(least, "label").select("node", "label", "least"), "node", "left").select("node", F.coalesce("least", "low").alias("low"), F.coalesce("label", "node").alias("group"))
    else:
        whole = whole.withColumn("group", F.col("node"))
    out = lookup(sketch.select("id", "text_hash", F.col("n").alias("n_shingles"), "node"), whole, "node", "left")
    return out.select("id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("id")).alias("component"), "group")


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with one row of each group (the one of the least id); rows without words all stay."""
    g = jaccard_groups(docs, id_col, text_col)
    best = g.where("n_shingles > 0").groupBy("group").agg(F.min_by("text_hash", F.struct("id", "text_hash")).alias("_key")).select("_key")
    rows = g.groupBy(F.col("text_hash").alias("_key")).agg(F.count("*").alias("_rows"), F.max("n_shingles").alias("_n"))
    chosen = rows.join(best.withColumn("_best", F.lit(True)), "_key", "left").where("_best or _n = 0").select("_key", F.expr("_n > 0 and _rows > 1").alias("_many"), F.col("_rows").alias("n"))
    chosen = cut(chosen, "chosen")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    row = lookup(row, chosen.select("_key", "_many"), "_key", counts=chosen.select("_key", "n"))
    # of rows alike in id and text the one of least hash, so that reruns agree (maps have no hash)
    plain = [F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    once = row.where("_many").groupBy("_key").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row")).select("_row.*")
    return row.where("not _many").select("_row.*").unionByName(once)


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
t as (select doc_id, len(s)::bigint as n, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from o where 100 * o >= 75 * (na + nb - o)),
sym as (select a, b from e union all select b, a from e)
, r as (with recursive reach as (select doc_id as x, doc_id as y from documents union select reach.x, sym.b from reach join sym on reach.y = sym.a) select x, min(y) as c from reach group by x)
select doc_id, len(s)::bigint as n_shingles, coalesce(c, doc_id) as component_id from s join r on r.x = doc_id
"""
