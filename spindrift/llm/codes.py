"""Vector code compression: product codebooks by Elkan's Lloyd rounds over integers, with bounds kept between rounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scans import lookup
from .shared import arrow, cut, drop, free

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task handles at a time.
ROWS = 2048


@dataclass
class Codebook:
    """entries[part, entry, position], integers of ``scale`` times a component."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        """Of all components in decimal, comma-joined, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(df: DataFrame, id_col="vec_id", vec_col="embedding", parts: int = PARTS, scale: int = SCALE, keep: list[str] | None = None, name: str = "ints") -> DataFrame:
    """``keep`` columns (all by default) and the integers floor(scale * x) of each codable vector.

    Left out are vectors that are null, hold null or non-finite components, are
    empty or can't be cut into ``parts`` equal parts, differ in length from the
    codable vector of the least id (null ids last), or hold a component with
    which a squared error needs more than 63 bits.
    """
    keep = df.columns if keep is None else keep
    v = F.col(f"`{vec_col}`").cast("array<double>")
    n = F.size(v)
    top = F.sqrt(F.lit(float((1 << 63) - 1)) / F.greatest(n, F.lit(1))) / 2
    good = v.isNotNull() & (n > 0) & (n % parts == 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) * scale < top, F.lit(False)) & ~F.isnan(x))
    some = df.where(F.coalesce(good, F.lit(False)))
    by = F.struct(F.col(f"`{id_col}`").isNull().alias("a"), F.col(f"`{id_col}`").alias("b"), n.alias("c"))
    width = some.agg(F.min(by).alias("m")).first()["m"]
    return some.where(n == (width["c"] if width else 0)).select(*[F.col(f"`{c}`") for c in keep], F.transform(v, lambda x: F.floor(x * scale)).alias(free(keep, name)))


def first_entries(ints: DataFrame, id_col="vec_id", parts: int = PARTS, entries: int = ENTRIES, name: str = "ints") -> np.ndarray:
    """The parts of the ``entries`` vectors of least id (null last; of equal ids the lesser vector first; all if fewer)."""
    first = ints.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.col(name)).limit(entries).select(name).collect()
    got = np.array([r[0] for r in first], np.int64)
    return got.reshape(len(first), parts, -1).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, 0), np.int64)


def _up(d2: np.ndarray) -> np.ndarray:
    """Upper bounds of the roots of integers, as 4-byte floats."""
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), np.inf).astype(np.float32), np.float32(np.inf))


def _down(d2: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots of integers: the upper 16 bits of a 4-byte float, which only cut it off."""
    root = np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), 0).astype(np.float32), np.float32(0))
    return (root.view(np.uint32) >> 16).astype(np.uint16)


def _floats(low: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint32) << 16).view(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's entry of least squared distance (the first of equals), and all squared distances."""
    d2 = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        d = x[:, i, None] - c[None, :, i]
        d2 += d * d
    return d2.argmin(1), d2


def moved(x, c, old, code, upper, lower):
    """Elkan's step: (code, upper, lower, distances computed) for rows x after the entries moved from ``old`` to c.

    A row keeps its entry without a distance if its upper bound is strictly
    below half the way to the nearest other entry; another entry is left out if
    its lower bound or half its way from the row's entry is strictly above the
    upper bound. Whatever is left is compared in integers, so ties go to the
    lower index as they do without bounds.
    """
    step = _up(((c - old) ** 2).sum(1))
    low = np.maximum(_floats(lower) - step, 0).astype(np.float32)
    low = np.nextafter(low, np.float32(0)).clip(0)
    up = np.nextafter(upper + step[code], np.float32(np.inf))
    _, between = nearest(c, c)
    half = _floats(_down(between)) / 2
    np.fill_diagonal(half, np.inf)
    code, up = code.copy(), up.copy()
    todo = np.flatnonzero(up >= half.min(1)[code])
    n = 0
    if len(todo):
        own = ((x[todo] - c[code[todo]]) ** 2).sum(1)
        n += len(todo)
        up[todo] = _up(own)
        low[todo, code[todo]] = _floats(_down(own))
        open_ = (low[todo] <= up[todo, None]) & (half[code[todo]] <= up[todo, None])
        r, j = np.nonzero(open_)
        if len(r):
            d2 = ((x[todo[r]] - c[j]) ** 2).sum(1)
            n += len(r)
            low[todo[r], j] = _floats(_down(d2))
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            row, best = r[starts], np.minimum.reduceat(d2, starts)
            at = np.where(d2 == np.repeat(best, np.diff(starts, append=len(r))), j, len(c))
            at = np.minimum.reduceat(at, starts)
            now, was = code[todo[row]], own[row]
            better = (best < was) | ((best == was) & (at < now))
            code[todo[row[better]]] = at[better]
            up[todo[row[better]]] = _up(best[better])
    return code, up, (low.view(np.uint32) >> 16).astype(np.uint16), n


def _assign(rows: DataFrame, codebooks: tuple[np.ndarray, ...], carry: list[str], state: bool) -> DataFrame:
    """carry columns, ints and the state of each vector. With two codebooks (before, now) the rows hold a state, with one all distances are computed; without ``state`` only code and error are returned."""
    books = rows.sparkSession.sparkContext.broadcast(codebooks)
    at = len(carry)
    made = "ints array<bigint>, code binary, upper binary, lower binary, computed long" if state else "code string, error long, computed long"
    schema = StructType([*rows.select(*[F.col(f"`{c}`") for c in carry]).schema, *StructType.fromDDL(made)])

    def run(batches):
        *before, now = books.value
        parts, entries = now.shape[:2]
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                n = b.num_rows
                x = b.column(at).flatten().to_numpy().reshape(n, parts, -1)
                if before:
                    raw = [np.frombuffer(b"".join(b.column(at + i).to_pylist()), t).reshape(n, parts, -1) for i, t in ((1, np.uint8), (2, np.float32), (3, np.uint16))]
                code, upper = np.empty((n, parts), np.int64), np.empty((n, parts), np.float32)
                lower, count = np.empty((n, parts, entries), np.uint16), np.zeros(n, np.int64)
                done = 0
                for p in range(parts):
                    if before:
                        code[:, p], upper[:, p], lower[:, p], m = moved(x[:, p], now[p], before[0][p], raw[0][:, p, 0].astype(np.int64), raw[1][:, p, 0], raw[2][:, p])
                        done += m
                    else:
                        code[:, p], d2 = nearest(x[:, p], now[p])
                        upper[:, p], lower[:, p] = _up(d2[np.arange(n), code[:, p]]), _down(d2)
                        done += d2.size
                count[0] = done
                codes = code.astype(np.uint8)
                if state:
                    made = [b.column(at), *(pa.array([y[i].tobytes() for i in range(n)], pa.binary()) for y in (codes, upper, lower))]
                else:
                    d = x - now[np.arange(parts), code]
                    made = [pa.array([y.tobytes().hex() for y in codes], pa.string()), pa.array((d * d).sum((1, 2)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *made, pa.array(count, pa.int64())], names=schema.names)

    return arrow(rows, run, schema)


def _sums(state: DataFrame, parts: int, entries: int) -> DataFrame:
    """(part, entry, n, sums) of the vectors' parts, a row for each entry in use. Each task adds up its own first."""

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), None
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, parts, -1)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, parts)
            sums = np.zeros((parts, entries, x.shape[2]), np.int64) if sums is None else sums
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = arrow(state.select("ints", "code"), run, "part int, entry int, n long, sums array<bigint>")
    flat = each.select("part", "entry", "n", F.posexplode("sums").alias("i", "s"))
    by = flat.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return by.groupBy("part", "entry").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))


def learn(ints: DataFrame, keep: list[str], id_col="vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebook]:
    """The ``keep`` columns of ints (from ``integers``) with code, error and the number of distances computed in the last pass, and the codebook after ``rounds`` rounds.

    A round assigns every part to its nearest entry (squared Euclidean distance
    in integers, ties to the lower index) and moves each entry to the floor of
    its parts' mean; unused entries stay. A last pass assigns once more. Code,
    upper bounds and lower bounds are written to the shared folder between
    passes, so a lost executor costs no pass but the one that runs. What the
    driver holds is the codebook: parts * entries vectors of a part's width.
    """
    book = first_entries(ints, id_col, parts, entries)
    k = book.shape[1]
    if not k:
        empty = ints.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("computed"))
        return empty, Codebook(book, scale)
    rows, books, state = ints.select(*[F.col(f"`{c}`") for c in keep], "ints"), (book,), None
    for _ in range(rounds):
        new = cut(_assign(rows, books, keep, True), "codes")
        if state is not None:
            drop(state)
        state = rows = new
        book = book.copy()
        for r in _sums(state, parts, k).toLocalIterator():
            book[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
        books = (books[-1], book)
        rows = state.select(*[F.col(f"`{c}`") for c in keep], "ints", "code", "upper", "lower")
    out = cut(_assign(rows, books if rounds else (book,), keep, False), "coded")
    if state is not None:
        drop(state)
    return out, Codebook(book, scale)


def encode(df: DataFrame, id_col="vec_id", vec_col="embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, keep: list[str] | None = None) -> tuple[DataFrame, Codebook]:
    """``keep`` columns of df (all by default) with ``code`` (two hex digits a part) and ``error`` of each codable vector, and the codebook.

    Which vectors are codable ``integers`` says. Repeated rows are coded as often
    as they occur; fewer vectors than ``entries`` make fewer entries; an empty
    table gives none. At most 256 entries, so that an index has two digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    keep = df.columns if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    ints = cut(integers(src, "id", "vec", parts, scale, [*names, "id"]), "ints")
    coded, book = learn(ints, names, "id", parts, entries, rounds, scale)
    out = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]
    return coded.select(*out, F.col("code").alias(free(keep, "code")), F.col("error").alias(free([*keep, free(keep, "code")], "error"))), book


def decode(codes: DataFrame, book: Codebook, code_col="code", name: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for: the entries of its parts, each component at the middle of its integer's range."""
    values = (book.entries + 0.5) / book.scale
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in p]) for p in values])
    n = book.entries.shape[0]
    digit = lambda i: F.conv(F.substr(F.col(f"`{code_col}`"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(F.element_at(flat, i + 1), digit(i) + 1))
    return codes.withColumn(name, F.flatten(parts))


def code_report(df: DataFrame) -> DataFrame:
    """Per codable vector: its code and error, the error of its label, and the codebooks' SHA-256."""
    coded, book = encode(df, keep=["vec_id", "label"])
    by = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = cut(coded.withColumn("its", by), "errors")
    total = coded.groupBy("its").agg(F.sum("error").alias("label_error"))
    out = lookup(coded, total, "its")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


_DISTANCE = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEAREST = f"select p.id, p.part, any_value(p.v) as v, min({_DISTANCE} * 64 + c.entry) as m from p join {{}} c on c.part = p.part group by p.id, p.part"


def _update(a: str, c: str) -> str:
    """Entries ``c`` moved to their parts' floored means under the assignment ``a``."""
    return f"""select c.part, c.entry, coalesce(n.v, c.v) as v from {c} c left join (
  select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from (
    select part, m % 64 as entry, i, sum(v[i])::bigint as s, count(*)::bigint as n from {a}, (select unnest(range(1, (select max(len(v)) from p) + 1)) as i) group by all) group by all) n
  on n.part = c.part and n.entry = c.entry"""


SQL = f"""
with e as materialized (select vec_id, label, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) as v, row_number() over (order by vec_id nulls last, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint)) - 1 as id
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] as v from e, (select unnest(range(16)) as part)),
c0 as materialized (select part, id as entry, v from p where id < 64),
a1 as materialized ({_NEAREST.format("c0")}), c1 as materialized ({_update("a1", "c0")}),
a2 as materialized ({_NEAREST.format("c1")}), c2 as materialized ({_update("a2", "c1")}),
a3 as materialized ({_NEAREST.format("c2")}),
f as (select id, string_agg(format('{{:02x}}', (m % 64)::bigint), '' order by part) as code, sum(m // 64)::bigint as error from a3 group by id),
h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as s from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from f join e using (id), h
"""
