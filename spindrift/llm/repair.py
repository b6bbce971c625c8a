"""Token ids as binary shards under Re-Pair grammar compression, with random access."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, PIECE, mix, pieces, powers, strings
from .shared import arrow, cut

END = 2
#: Ids that fill a shard (it ends with the piece of texts that fills it), pairs replaced at most in one round, least count of a replaced pair,
#: and the share of itself by which a round must shorten the shard for another to follow.
SHARD = 1 << 20
BATCH = 4096
LEAST = 24
GAIN = 0.03
#: Words whose bytes are compared at once, bytes of text that are encoded at once, and words that a worker remembers (all are forgotten
#: beyond; it changes no ids).
SLICE, TEXT, WORDS = 1 << 14, PIECE >> 2, 400_000
MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIQQ")


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A text of plain Latin characters is split by the tokenizer's own pattern
    and its words go to the library's model, whose ids for a bounded number of
    words are remembered; of other texts, the pieces between ASCII white space
    (which no token spans) are handled so or go through the whole tokenizer. A
    tokenizer that does not behave so on a trial text is used on whole texts.
    """

    def __init__(self, path: str, most: int = WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = most
        self.forget()
        text = "Ab, cd's\n12 éÜ! x<|endoftext|> \t_z'll über-ÑA--9 3.5'%s $$$the&&& 've' 一 á"
        self.by_word = True
        self.by_word = self(["Ab 'll", text]) == [self._whole("Ab 'll"), self._whole(text)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if "<|" not in text and _PLAIN(text) is not None:
            return np.array([i for w in _PARTS(text.lower()) for i in self._word(w)], "<u4").tobytes()
        pieces = _SPLIT(text)
        return self._whole(text) if len(pieces) < 2 else b"".join(map(self._one, pieces))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]

    def encode(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with ``end`` behind it, and the bounds of the texts.

        Words are found by 64-bit hashes of their lower-cased bytes, each
        distinct word of the column is looked up once, and new ones go to the
        model. The bytes of every word are compared with those remembered: texts
        in which a hash stands for another word, and those that aren't plain, go
        the slow way of ``_one``.
        """
        data, bounds = strings(col)
        n = len(bounds) - 1
        low, before, after = LOWER[data], np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
        before[1:], after[:-1] = data[:-1], low[1:]
        inner = before == 0xC3
        low[inner & (data < 0x9F) & (data >= 0x80)] += 32
        bad = _NEVER[data] | (data >= 0x80) & (data != 0xC3) & (~inner | (data == 0x97) | (data == 0xB7)) | (data == 0x27) & _AFTER[after] | (data == 0x3C) & (after == 0x7C)
        kind = _KIND[data]
        slow = set(range(n)) if not self.by_word else set((np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1).tolist()) if bad.any() else set()
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        turn = first.copy()
        turn[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(turn[:-1] & (kind > 0))
        ends = np.flatnonzero(turn[1:] & (kind > 0)) + 1
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts])
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = self._slots(distinct, lambda k: low[starts[where[k]] : ends[where[k]]].tobytes())
        slow |= set((np.searchsorted(bounds, starts[self._unlike(low, starts, ends - starts, at[back])], "right") - 1).tolist())
        size, place = self.size[at][back], self.place[at][back]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        per = total[np.searchsorted(starts, bounds)]
        if slow:
            texts = col.to_pylist()
            each = [np.frombuffer(self._one(texts[i] or ""), "<u4") if i in slow else ids[per[i] : per[i + 1]] for i in range(n)]
            ids, per = np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        per = per + np.arange(n + 1)
        out = np.full(per[-1], end, np.uint32)
        stay = np.ones(len(out), bool)
        stay[per[1:] - 1] = False
        out[stay] = ids
        return out, per

    def _slots(self, distinct: np.ndarray, spell) -> np.ndarray:
        """Slots of word hashes (ascending), after the model has seen the new ones."""
        if len(self.keys) + len(distinct) > self.most:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct if len(self.keys) else np.ones(len(distinct), bool))
        if len(new):
            raw = [spell(k) for k in new.tolist()]
            got = [self._word(w.decode("utf-8", "replace")) for w in raw]
            n = np.array([len(x) for x in got], np.int64)
            spot = self.fill + np.cumsum(n) - n
            while self.fill + n.sum() > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.fill : self.fill + n.sum()] = [i for x in got for i in x]
            self.fill += int(n.sum())
            long = np.array([len(w) for w in raw], np.int64)
            self.length, self.spelt = np.insert(self.length, at[new], long), np.insert(self.spelt, at[new], self.written + np.cumsum(long) - long)
            while self.written + long.sum() > len(self.letters):
                self.letters = np.concatenate([self.letters, np.zeros(len(self.letters), np.uint8)])
            self.letters[self.written : self.written + long.sum()] = np.frombuffer(b"".join(raw), np.uint8)
            self.written += int(long.sum())
            self.keys, self.size, self.place = np.insert(self.keys, at[new], distinct[new]), np.insert(self.size, at[new], n), np.insert(self.place, at[new], spot)
            at = np.searchsorted(self.keys, distinct)
        return at

    def _unlike(self, low: np.ndarray, starts: np.ndarray, n: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Words (by number) whose bytes aren't those remembered in their slot."""
        out = [np.flatnonzero(self.length[slot] != n)]
        for a in range(0, len(n), SLICE):  # some words at a time, so that no array is as long as the text
            same = a + np.flatnonzero(self.length[slot[a : a + SLICE]] == n[a : a + SLICE])
            k = n[same]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            off = low[np.repeat(starts[same], k) + step] != self.letters[np.repeat(self.spelt[slot[same]], k) + step]
            if off.any():
                out.append(np.unique(np.repeat(same, k)[off]))
        return np.concatenate(out)

    def _word(self, w: str) -> list[int]:
        return [x.id for x in self.tok.model.tokenize(w if w.isascii() else "".join([_BYTE[b] for b in w.encode()]))]

    def forget(self) -> None:
        self.length, self.spelt, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint8)
        self.written = 0
        self.keys, self.size, self.place, self.pool, self.fill = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0


# Fixed values of the tokenizer: the pattern that parts a text (its letters, digits and spaces written out for the
# plain characters), and the printable character that stands for each byte.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+").findall
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\t-\r ]*").fullmatch
_SPLIT = re.compile("[^\t-\r ]+").findall
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 0, 2, 1, 1, 1
_NEVER = np.zeros(256, bool)
_NEVER[:9] = _NEVER[14:32] = _NEVER[127] = True
_AFTER = np.isin(np.arange(256), np.frombuffer(b"strvmld", np.uint8))
_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker; its words outlive a task."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def compress(ids: np.ndarray, bounds: np.ndarray, batch: int = BATCH, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: replace frequent adjacent pairs by new symbols, round by round.

    A round counts all pairs inside documents and replaces up to ``batch`` of
    the most frequent that occur ``least`` times; where two chosen pairs overlap
    the more frequent wins. Ends when a round shortens the shard by less than
    ``gain`` of itself. Returns the rules (pairs of symbols, the first standing
    for the largest id + 1), the symbols left, and the documents' bounds among them.
    """
    seq, at, rules = ids.astype(np.int64), np.asarray(bounds, np.int64), []
    fresh = int(seq.max()) + 1 if len(seq) else 0
    bits = max(16, (4 * batch - 1).bit_length())

    def slot(key):
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    while len(seq) > 1:
        key = (seq[:-1] << 32) | seq[1:]
        inner = at[(at > 0) & (at < len(seq))]
        key[inner - 1] = -1
        order = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        n = np.diff(np.append(first, len(order)))
        on = n >= least
        pairs, n = order[first[on]], n[on]
        pairs, n = pairs[pairs >= 0], n[pairs >= 0]
        if not len(pairs):
            break
        pairs = pairs[np.lexsort((pairs, -n))[:batch]]
        # a table from pair to rank; of pairs in one slot the most frequent stands, the others wait for a later round
        rank, held = np.full(1 << bits, len(pairs), np.int32), np.full(1 << bits, -1, np.int64)
        s = slot(pairs)[::-1]
        rank[s], held[s] = np.arange(len(pairs), dtype=np.int32)[::-1], pairs[::-1]
        s = slot(key)
        r = rank[s]
        pick = held[s] == key
        pick[inner - 1] = False
        r[~pick] = len(pairs)
        runs = np.zeros(len(r), bool)  # a pair of equal symbols overlaps itself: every other place of a run is taken
        runs[1:] = pick[1:] & (r[1:] == r[:-1])
        if runs.any():
            place = np.arange(len(r))
            pick &= ((place - np.maximum.accumulate(np.where(runs, 0, place))) & 1) == 0
        pick[1:] &= r[1:] <= r[:-1]
        pick[:-1] &= r[:-1] <= r[1:]
        where = np.flatnonzero(pick)
        hits = np.bincount(r[where], minlength=len(pairs))
        used = np.flatnonzero(hits)
        name = np.zeros(len(pairs), np.int64)
        name[used] = fresh + np.arange(len(used))
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        seq[where] = name[r[where]]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        at = at - np.searchsorted(where, at - 1)
        short = len(where) < gain * len(seq)
        seq = seq[stay]
        fresh += len(used)
        if short:
            break
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), seq, at


def _pack(x: np.ndarray) -> tuple[int, bytes]:
    """Symbols in as many whole bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpack(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view("<u4").astype(np.int64)


def write_shard(doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """One shard: header, rules, expansion lengths, document table, symbols (little-endian throughout).

    MAGIC, u32 base (first rule's symbol), u32 rules, u32 symbol width, u64 documents, u64 symbols;
    u32 pairs of the rules; u32 expansion length of each rule; i64 document ids;
    u64 symbol bounds (documents + 1); u64 id bounds (documents + 1); the symbols.
    """
    rules, seq, at = compress(ids, bounds)
    base = int(ids.max()) + 1 if len(ids) else 0
    width, raw = _pack(seq)
    head = _HEAD.pack(MAGIC, base, len(rules), width, len(doc_ids), len(seq))
    return b"".join([head, rules.astype("<u4").tobytes(), lengths(rules, base).astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), at.astype("<u8").tobytes(), bounds.astype("<u8").tobytes(), raw])


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to. A rule only uses symbols of earlier ones."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


class Shard:
    """Reads a shard; decodes one document, or any range of its ids, without the others."""

    def __init__(self, raw: bytes):
        magic, self.base, n_rules, width, n, n_sym = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, v = _HEAD.size, memoryview(raw)

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(v, kind, k, at)
            at += out.nbytes
            return out.astype(np.int64)

        self.rules, self.length = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.doc_ids, self.symbol_at, self.id_at = take("<i8", n), take("<u8", n + 1), take("<u8", n + 1)
        self.symbols = _unpack(v[at:], n_sym, width)

    def sizes(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        on = s >= self.base
        out[on] = self.length[s[on] - self.base]
        return out

    def expand(self, s: np.ndarray) -> np.ndarray:
        while len(on := np.flatnonzero(s >= self.base)):
            n = np.ones(len(s), np.int64)
            n[on] = 2
            at = (np.cumsum(n) - n)[on]
            pair = self.rules[s[on] - self.base]
            s = np.repeat(s, n)
            s[at], s[at + 1] = pair[:, 0], pair[:, 1]
        return s

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]])

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document k; only the symbols that cover them are expanded."""
        s = self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]]
        ends = np.cumsum(self.sizes(s))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(s[a:b])[start - skip : stop - skip]


def write_shards(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", shard: int = SHARD, end: int = END, partitions: int | None = None) -> DataFrame:
    """Encode docs in ascending id order and write the shards; returns the written table (part, seq, n_ids, payload).

    Each row's payload is one shard file. They stand in a Parquet table in the
    shared folder, so Spark's commit protocol makes a lost task's half-written
    files vanish and any store works. Documents are dealt by ranges of the id
    (ties by a hash of the text, so one id on many rows is dealt over several, and
    equal rows by a number of the row, as they may go anywhere among themselves).
    Null texts are empty, null ids come first and are written as -1, empty
    tables write no shard, repeated rows are written as often as they occur.
    """
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).withColumn("x", F.xxhash64("t")).withColumn("r", F.monotonically_increasing_id())
    by = ("i", "x", "r")
    src = (src.repartitionByRange(partitions, *by) if partitions else src.repartitionByRange(*by)).sortWithinPartitions("i", "x").select("i", "t")

    def run(batches):
        from pyspark import TaskContext


        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, got, ends, size = [], [], [], 0

        def flush():
            ids, bounds = np.concatenate(got), np.concatenate([[0], np.cumsum(np.concatenate(ends))])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([write_shard(np.array(held), ids, bounds)], pa.binary())})

        for b in batches:
            for p in pieces(b, 1, min(TEXT, 4 * shard)):
                ids, bounds = enc.encode(p.column(1), end)
                held += [-1 if i is None else i for i in p.column(0).to_pylist()]
                got.append(ids)
                ends.append(np.diff(bounds))
                size += len(ids)
                if size >= shard:
                    yield flush()
                    held, got, ends, size, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()

    return cut(arrow(src, run, "part int, seq long, n_ids long, payload binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode every document: (doc_id, start, n_tokens, ids_crc32, part, seq, place), start counting all ids before it in order of part, seq, place."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part as p", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    each = shards.selectExpr("part as p", "seq as s", "coalesce(sum(n_ids) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0) as within")
    base = each.join(parts, "p").selectExpr("p as part", "s as seq", "before + within as first")

    def run(batches):
        for b in batches:
            for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Shard(raw.as_py())
                n = len(s.doc_ids)
                flat = s.expand(s.symbols).astype("<u4")
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(s.id_at[:-1], s.id_at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int64()), "place": pa.array(np.arange(n)), "doc_id": pa.array(s.doc_ids), "offset": pa.array(s.id_at[:-1]), "n_tokens": pa.array(np.diff(s.id_at)), "ids_crc32": pa.array(crc, pa.int64())})

    out = arrow(shards.select("part", "seq", "payload"), run, "part int, seq long, place long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return out.join(base, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "place")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer or default_tokenizer())).select("doc_id", "start", "n_tokens", "ids_crc32")
