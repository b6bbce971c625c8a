"""Line dedup: two Bloom filters (seen once, seen twice) tell which lines may repeat; only those are shuffled and counted."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import lookup
from .kernel import LOWER, SPACED, mix, pieces, strings, word_hashes
from .shared import arrow, cut, drop, free

#: Documents in which a line must be found to be dropped.
LEAST = 10
#: Bits of a segment of the filters, and the most segments: 32 MB, the bound of what is broadcast. Beyond it more lines are suspected; none is lost.
SEGMENT, SEGMENTS = 1 << 20, 256
#: Bits of a filter for each line.
BITS = 16
#: Lines that a task remembers before it sends on what it has seen.
HELD = 1 << 20
#: Repeated lines with more than one in so many of all suspected places number fewer than this, and are broadcast; the others are joined.
COMMON = 1 << 18


def split(data: np.ndarray, bounds: np.ndarray):
    """Start and end byte of each line and of its key (start = end: no key), and the document of each line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    # a break belongs to the last document that starts at or before it
    per = np.bincount(np.searchsorted(bounds, breaks, "right") - 1, minlength=len(bounds) - 1) + 1
    doc = np.repeat(np.arange(len(bounds) - 1), per)
    solid = np.flatnonzero(SPACED[data]) if len(data) else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    a, b = starts.copy(), starts.copy()
    a[full], b[full] = solid[lo[full]], solid[hi[full] - 1] + 1
    return starts, ends, a, b, doc


def _hashes(data, a, b):
    """The lines that have a key, and its hash with A-Z lower-cased."""
    at = np.flatnonzero(b > a)
    return at, word_hashes(data, a[at], b[at])


def _bits(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of each hash, which lie in one segment."""
    base = ((h >> np.uint64(40)) % np.uint64(segments)).astype(np.int64) * SEGMENT
    low = np.uint64(SEGMENT - 1)
    return base + (h & low).astype(np.int64), base + (mix(h) & low).astype(np.int64)


def _packed(pos: np.ndarray) -> bytes:
    """Ascending bits of a segment: their distances as 4-byte numbers, or the whole segment where that is less."""
    if len(pos) * 32 < SEGMENT:
        return np.diff(pos, prepend=0).astype("<u4").tobytes()
    whole = np.zeros(SEGMENT, bool)
    whole[pos] = True
    return np.packbits(whole).tobytes()


def _opened(raw: bytes) -> np.ndarray:
    if len(raw) == SEGMENT // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))
    return np.cumsum(np.frombuffer(raw, "<u4").astype(np.int64))


def _seen(text: DataFrame, segments: int) -> DataFrame:
    """(segment, once, twice): bits of the lines that a task has seen, and of those that it has seen in two documents."""

    def rows(held):
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        h, back = np.unique(h, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(h))
        once = np.unique(np.concatenate(_bits(h, segments)))
        twice = np.unique(np.concatenate(_bits(h[n > 1], segments)))
        out = []
        for s in np.unique(once // SEGMENT).tolist():
            cut_ = [x[np.searchsorted(x, s * SEGMENT) : np.searchsorted(x, (s + 1) * SEGMENT)] - s * SEGMENT for x in (once, twice)]
            out.append((s, _packed(cut_[0]), _packed(cut_[1])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))], names=["segment", "once", "twice"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for p in pieces(b, 0):
                data, bounds = strings(p.column(0))
                _, _, x, y, doc = split(data, bounds)
                at, h = _hashes(data, x, y)
                order = np.lexsort((h, doc[at]))
                h, d = h[order], doc[at][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, n = np.unique(h[new], return_counts=True)
                held.append((h, n))
                size += len(h)
                if size > HELD:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return arrow(text, run, "segment int, once binary, twice binary")


def _merged(seen: DataFrame) -> DataFrame:
    """(segment, bits) of the filter of lines seen twice. Rows come one by one; a task holds the two filters of its segments, 32 MB for each at most."""

    def run(batches):
        once, twice = {}, {}
        for b in batches:
            for s, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s not in once:
                    once[s], twice[s] = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                x, y = _opened(x), _opened(y)
                twice[s][x] |= once[s][x]
                twice[s][y] = True
                once[s][x] = True
        keys = sorted(twice)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([np.packbits(twice[s]).tobytes() for s in keys], pa.binary())], names=["segment", "bits"])

    return arrow(seen.repartition("segment"), run, "segment int, bits binary")


def twice_filter(text: DataFrame, n_lines: int, most: int = SEGMENTS):
    """A broadcast filter that holds each line found in two rows of ``text`` or more, and few others; its bytes are bounded by ``most`` segments."""
    segments = min(most, max(1, -(-n_lines * BITS // SEGMENT)))
    table = np.zeros(segments * SEGMENT // 8, np.uint8)
    for r in _merged(_seen(text, segments)).toLocalIterator():
        table[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return text.sparkSession.sparkContext.broadcast(table), segments


def _suspects(data, a, b, filt, segments):
    """The lines that the filter holds, and the digest of each one's key."""
    at, h = _hashes(data, a, b)
    ok = np.ones(len(at), bool)
    for p in _bits(h, segments):
        ok &= (filt[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    at, low = at[ok], LOWER[data].tobytes() if len(data) else b""
    return at, [hashlib.md5(low[x:y]).digest() for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]


def _counted(src: DataFrame, filt, segments: int) -> DataFrame:
    """(key, n, id, row, line) from (text, row, id): how many documents of about a megabyte hold a suspected line, and the place of the least row that does."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for p in pieces(b, 0):
                data, bounds = strings(p.column(0))
                _, _, x, y, doc = split(data, bounds)
                at, keys = _suspects(data, x, y, filt.value, segments)
                first_line = np.searchsorted(doc, np.arange(p.num_rows))
                order = pa.compute.sort_indices(pa.table({"id": p.column(2), "row": p.column(1)}), sort_keys=[("id", "ascending"), ("row", "ascending")]).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                seen: dict = {}
                for i, k in zip(at.tolist(), keys, strict=True):
                    d = doc[i]
                    n, best, last = seen.get(k, (0, None, -1))
                    place = (rank[d], i)
                    seen[k] = (n + (last != d), place if best is None or place < best else best, d)
                rows = [best[1] for _, best, _ in seen.values()]
                docs = pa.array([int(doc[i]) for i in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.binary()), pa.array([n for n, _, _ in seen.values()], pa.int64()), p.column(2).take(docs), p.column(1).take(docs), pa.array([int(i - first_line[doc[i]]) for i in rows], pa.int64())],
                    names=["key", "n", "id", "row", "line"],
                )

    return arrow(src, run, f"key binary, n long, id {kind}, row long, line long")


def repeated_lines(src: DataFrame, least: int, filt, segments: int) -> tuple[DataFrame, int]:
    """(key, n, row, line) of the lines found in ``least`` rows of src (text, row, id) or more, row and line being the first place, and the number of suspected places."""
    seen = cut(_counted(src, filt, segments), "suspects")
    places = seen.agg(F.sum("n")).first()[0] or 0
    by = F.struct(F.col("id").isNull(), "id", "row", "line")
    out = cut(seen.groupBy("key").agg(F.sum("n").alias("n"), F.min_by(F.struct("row", "line"), by).alias("p")).where(F.col("n") >= least).select("key", "n", "p.*"), "lines")
    drop(seen)
    return out, places


def _stripped(src: DataFrame, names: list[str], filt, segments: int, common: dict, name: str) -> DataFrame:
    """The columns ``names`` of src (they come first, then text, row and more) and the struct that ``drop_lines`` describes."""
    known = src.sparkSession.sparkContext.broadcast(common)
    schema = src.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("struct<n_lines:bigint,n_dropped:bigint,text:string>").alias(name)).schema
    at = len(names)

    def run(batches):
        first = known.value
        for b in batches:
            for p in pieces(b, at):
                data, bounds = strings(p.column(at))
                starts, ends, x, y, doc = split(data, bounds)
                gone = np.zeros(len(starts), bool)
                lo = np.searchsorted(doc, np.arange(p.num_rows + 1))
                lines, keys = _suspects(data, x, y, filt.value, segments)
                rows, more = p.column(at + 1).to_numpy(zero_copy_only=False), p.column(at + 2).to_pylist()
                extra = [None if m is None else {r["key"]: (r["row"], r["line"]) for r in m} for m in more]
                for i, k in zip(lines.tolist(), keys, strict=True):
                    d = doc[i]
                    place = first.get(k) or (extra[d] or {}).get(k)
                    gone[i] = place is not None and place != (rows[d], i - lo[d])
                dropped = np.add.reduceat(gone, lo[:-1], dtype=np.int64) if len(gone) else np.zeros(p.num_rows, np.int64)
                raw, texts = data.tobytes(), []
                for d in range(p.num_rows):
                    if dropped[d]:
                        texts.append(b"\n".join(raw[starts[i] : ends[i]] for i in range(lo[d], lo[d + 1]) if not gone[i]).decode())
                    else:
                        texts.append(raw[bounds[d] : bounds[d + 1]].decode())
                s = pa.StructArray.from_arrays([pa.array(np.diff(lo), pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["n_lines", "n_dropped", "text"])
                yield pa.RecordBatch.from_arrays([*p.columns[:at], s], names=[*names, name])

    return arrow(src, run, schema)


def drop_lines(docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, keep_first: bool = False, name: str = "found", keep: list[str] | None = None, most: int = SEGMENTS, common: int = COMMON) -> DataFrame:
    """``keep`` columns of docs (all by default) and a struct ``name`` {n_lines, n_dropped, text}: the text without repeated lines.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased. Keys found in ``least`` rows (2 or more) lose all their lines,
    or with ``keep_first`` all but the first: that of the least id (null last),
    of equal ids the row of the lesser hash, and there the topmost. Rows alike in
    id and text keep it alike. A line that repeats within one row counts once
    there; lines without a key always stay. A null or empty text is one empty
    line. Every row is a document, ids may repeat or be null; empty tables give
    none; extra columns may have any name.

    A task sends the bits of the lines that it has seen, once and twice, and a
    task for each segment ORs them: a bit seen once by two tasks, or twice by
    one, is set in the second filter, which therefore holds every repeated line.
    Suspected lines are counted by a 128-bit digest, summed up before each
    shuffle. Of the repeated ones those in more than one of ``common`` suspected
    places are broadcast (fewer than ``common`` by that bound); the others are
    joined to their documents.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    kept = docs.columns if keep is None else keep
    out_name = free(kept, name)
    made, taken = [], [*kept, out_name]
    for n in ("_text_", "_row_", "_more_", "_id_"):
        made.append(free(taken, n))
        taken.append(made[-1])
    text, row, more, key = made
    col = F.col(f"`{text_col}`")
    base = docs.select(*[F.col(f"`{c}`") for c in kept], col.alias(text), F.xxhash64(F.col(f"`{id_col}`"), col).alias(row), F.col(f"`{id_col}`").alias(key))
    src = base.select(F.col(text).alias("text"), F.col(row).alias("row"), F.col(key).alias("id"))
    n = docs.agg(F.sum(F.coalesce(F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    filt, segments = twice_filter(src.select("text"), n, most)
    lines, places = repeated_lines(src, least, filt, segments)
    if not keep_first:
        lines = lines.withColumn("row", F.lit(0).cast("long")).withColumn("line", F.lit(-1).cast("long"))
    often = {bytes(r.key): (r.row, r.line) for r in lines.where(F.col("n") * common > places).toLocalIterator()}
    rest = lines.where(F.col("n") * common <= places)
    plain = F.lit(None).cast("array<struct<key:binary,row:bigint,line:bigint>>").alias(more)
    order = [F.col(f"`{c}`") for c in kept]
    if rest.limit(1).count():
        theirs = cut(_places(src, filt, segments, often).join(rest.select("key", F.struct("key", F.col("row").alias("row"), F.col("line").alias("line")).alias("at")), "key").groupBy("row_").agg(F.collect_set("at").alias(more)).withColumnRenamed("row_", row), "more")
        full = lookup(cut(base, "rows"), theirs, row, "left").select(*order, text, row, more)
    else:
        full = base.select(*order, text, row, plain)
    return _stripped(full, kept, filt, segments, often, out_name)


def _places(src: DataFrame, filt, segments: int, often: dict) -> DataFrame:
    """(row_, key) of the suspected lines that aren't among those broadcast."""
    known = src.sparkSession.sparkContext.broadcast(set(often))

    def run(batches):
        skip = known.value
        for b in batches:
            for p in pieces(b, 0):
                data, bounds = strings(p.column(0))
                _, _, x, y, doc = split(data, bounds)
                at, keys = _suspects(data, x, y, filt.value, segments)
                got = {(int(doc[i]), k) for i, k in zip(at.tolist(), keys, strict=True) if k not in skip}
                yield pa.RecordBatch.from_arrays([p.column(1).take(pa.array([d for d, _ in got], pa.int64())), pa.array([k for _, k in got], pa.binary())], names=["row_", "key"])

    return arrow(src, run, "row_ long, key binary")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of what is kept."""
    found = drop_lines(docs, keep=["doc_id"])
    return found.select("doc_id", "found.n_lines", "found.n_dropped", F.sha2(F.col("found.text"), 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, r, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
g as (select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (key in (select key from g)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (select key from g)), '')) as kept_sha256
from k group by doc_id, r
"""
