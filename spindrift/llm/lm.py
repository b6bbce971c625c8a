"""LM scoring: per-token cross-entropy difference between a target and a background n-gram model.

Both models are word bigrams interpolated with unigrams. Every distinct word and
bigram is counted: texts are laid out in sheets of a few MB, each sheet asks for
its distinct words and bigrams once, ranges of their hashes sum what all sheets
ask and answer with the sums, and the sheets are scored with the answers. The
number of ranges follows the tokens, so no task holds a whole table; a frequent
word costs a range one key a sheet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, mix, pieces, strings, word_hashes, words
from .shared import arrow, cut, drop

#: Bytes of text in a sheet, keys that a range is asked for at most (on average), and the largest number of target ids that is broadcast.
SHEET, KEYS, BROADCAST = 4 << 20, 1 << 21, 2_000_000
#: Observations of a word at which its bigrams weigh a half, and add-alpha smoothing of unigrams.
KAPPA, ALPHA = 5.0, 0.1


def _hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = strings(col)
    starts, ends, at = words(data, bounds, SPACED)
    return word_hashes(data, starts, ends), at


class Sheet:
    """The words of some texts: their distinct hashes, the place of each token's among them, the n + 1 bounds of the texts, and the same of bigrams (``right`` holds the tokens that end one)."""

    def __init__(self, target: np.ndarray, at: np.ndarray, own: np.ndarray, tokens: np.ndarray):
        self.target, self.at, self.own, self.tokens = target, at, own, tokens.astype(np.int64)
        inner = np.ones(len(tokens), bool)
        inner[at[:-1][at[:-1] < len(tokens)]] = False
        self.right = np.flatnonzero(inner)
        codes, self.pairs = np.unique(self.tokens[self.right - 1] * len(own) + self.tokens[self.right], return_inverse=True)
        left, right = np.divmod(codes, max(1, len(own)))
        self.bigrams = mix(mix(own[left]) + own[right])

    def asked(self, ranges: int):
        """(kind, keys, place of each token's key, texts' tokens, order of the keys by range, bounds of the ranges) of words (0) and bigrams (1)."""
        for kind, keys, place, at in ((0, mix(self.own), self.tokens, slice(None)), (1, self.bigrams, self.pairs, self.right)):
            order = np.argsort(keys)
            r = (keys[order] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            yield kind, keys, place, at, order, np.searchsorted(r, np.arange(ranges + 1).astype(np.uint64))

    def losses(self, uni: np.ndarray, bi: np.ndarray, total: tuple, size: int) -> np.ndarray:
        """Mean bits per token of each text (row) under either model (0 target, 1 background), what the text itself brought to a model taken out."""
        n = np.diff(self.at)
        doc = np.repeat(np.arange(len(n)), n)
        own = []
        for place, keys, d in ((self.tokens, self.own, doc), (self.pairs, self.bigrams, doc[self.right])):
            _, back, times = np.unique(d * max(1, len(keys)) + place, return_inverse=True, return_counts=True)
            own.append(times[back])
        out = np.zeros((len(n), 2))
        for m in (0, 1):
            takes = (self.target | (m == 1))[doc]
            one = (uni[m][self.tokens] - own[0] * takes).astype(float)
            two = (bi[m][self.pairs] - own[1] * takes[self.right]).astype(float)
            p = (one + ALPHA) / (total[m] - n[doc] * takes + ALPHA * size)
            before = one[self.right - 1]
            lam = before / (before + KAPPA)
            p[self.right] = lam * np.minimum(two, before) / np.maximum(before, 1) + (1 - lam) * p[self.right]
            out[:, m] = np.bincount(doc, -np.log2(p), len(n)) / np.maximum(n, 1)
        return out


def _sheets(marked: DataFrame) -> DataFrame:
    """Rows (piece, n, ids, target, at, a, b) from (text, target, id): a sheet's tokens, bounds, distinct words and their places."""

    def run(batches):
        from pyspark import TaskContext

        no, held, size = TaskContext.get().partitionId() << 32, [], 0

        def sheet():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h, at = _hashed(b.column(0))
            own, tokens = np.unique(h, return_inverse=True)
            whole = pa.array([0, b.num_rows], pa.int32())
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (_gaps(at), _gaps(own), tokens)]
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([len(h)], pa.int64()), pa.ListArray.from_arrays(whole, b.column(2)), pa.ListArray.from_arrays(whole, b.column(1)), *blobs], names=["piece", "n", "ids", "target", "at", "a", "b"])

        for b in batches:
            for p in pieces(b, 0, SHEET):
                more = pc.sum(pc.binary_length(p.column(0))).as_py() or 0
                if held and size + more > SHEET:
                    yield sheet()
                    no, held, size = no + 1, [], 0
                held.append(p)
                size += more
        if any(p.num_rows for p in held):
            yield sheet()

    kind = dict(marked.dtypes)["id"]
    return cut(arrow(marked.select("text", "target", "id"), run, f"piece long, n long, ids array<{kind}>, target array<boolean>, at binary, a binary, b binary"), "sheets")


def _sheet(target: pa.Array, at: bytes, own: bytes, tokens: bytes) -> Sheet:
    return Sheet(target.to_numpy(zero_copy_only=False).astype(bool), np.cumsum(_unpacked(at)).astype(np.int64), np.cumsum(_unpacked(own)), _unpacked(tokens))


def _packed(n: np.ndarray) -> bytes:
    """64-bit numbers: how many, and their bytes by significance, compressed."""
    planes = np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(n).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _counts(blobs: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_unpacked(b).astype(np.int64) for b in blobs)])


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences; ``np.cumsum`` gives them back."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _answers(sheets: DataFrame, ranges: int) -> DataFrame:
    """Rows (piece, kind, r, a, b): both models' counts of the keys in range r that the sheet asked for; those of piece -1 have the range's distinct words and both models' words."""

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                piece, at, own, tokens = (b.column(k)[i].as_py() for k in (0, 2, 3, 4))
                s = _sheet(b.column(1).slice(i, 1).flatten(), at, own, tokens)
                hit = np.repeat(s.target, np.diff(s.at))
                rows = []
                for kind, keys, place, where, order, bounds in s.asked(ranges):
                    n = [np.bincount(place[hit[where]], minlength=len(keys))[order], np.bincount(place, minlength=len(keys))[order]]
                    key = keys[order]
                    rows += [(r, kind, piece, _packed(_gaps(key[x:z])), _packed(n[0][x:z]), _packed(n[1][x:z])) for r, (x, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if z > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["r", "kind", "piece", "keys", "a", "b"])

    def answer(batches):
        of, held = None, []

        def reply():
            r, kind = of
            keys = [np.cumsum(_unpacked(x[1])) for x in held]
            ends = np.cumsum([0, *map(len, keys)])
            keys, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = [np.zeros(len(keys), np.int64) for _ in (0, 1)]
            for m in (0, 1):
                np.add.at(n[m], back, _counts([x[2 + m] for x in held]))
            out = [(x[0], _packed(n[0][back[a:z]]), _packed(n[1][back[a:z]]), None, None, None) for x, a, z in zip(held, ends[:-1], ends[1:], strict=True)]
            if not kind:
                out.append((-1, None, None, len(keys), int(n[0].sum()), int(n[1].sum())))
            cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array([r] * len(out), pa.int32())]
            cols += [pa.array([x[k] for x in out], pa.binary() if k < 3 else pa.int64()) for k in range(1, 6)]
            return pa.RecordBatch.from_arrays(cols, names=["piece", "kind", "r", "a", "b", "words", "n0", "n1"])

        for b in batches:
            for r, kind, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (r, kind):
                    if held:
                        yield reply()
                    of, held = (r, kind), []
                held.append(row)
        if held:
            yield reply()

    asked = arrow(sheets.select("piece", "target", "at", "a", "b"), ask, "r int, kind int, piece long, keys binary, a binary, b binary")
    return cut(arrow(asked.repartition("r", "kind").sortWithinPartitions("r", "kind"), answer, "piece long, kind int, r int, a binary, b binary, words long, n0 long, n1 long"), "answers")


def difference(docs: DataFrame, target_ids: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, score) for each row; score is the target's loss less the background's, in bits a token (lower: more like the target).

    Null and empty texts have no tokens and scores 0. Texts that repeat are
    counted as often as they occur; an empty target leaves its model uniform.
    """
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_id_")).where("_id_ is not null").distinct().withColumn("_hit_", F.lit(True))
    ids = cut(ids, "target")
    small = ids.count() <= BROADCAST
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = marked.join(F.broadcast(ids) if small else ids, F.col("id") == F.col("_id_"), "left").select("text", F.coalesce("_hit_", F.lit(False)).alias("target"), "id")
    sheets = _sheets(marked)
    drop(ids)
    tokens = sheets.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-2 * tokens // KEYS))
    answers = _answers(sheets, ranges)
    known = answers.where("piece < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n0", "n1")]).first()
    size, total = known[0] + 1, (known[1], known[2])  # one more for all words not seen

    def score(batches):
        head, got = None, []

        def scored():
            ids, s = head
            n = []
            for kind, keys, _, _, order, _ in s.asked(ranges):
                mine = [x for x in got if x[0] == kind]
                both = np.zeros((2, len(keys)), np.int64)
                for m in (0, 1):
                    both[m][order] = _counts([x[1 + m] for x in mine])
                n.append(both)
            a = s.losses(*n, total, size)
            return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(s.at)), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 0] - a[:, 1])], names=["id", "n_tokens", "loss_target", "loss_background", "score"])

        for b in batches:
            for i in range(b.num_rows):
                kind, at, x, y = (b.column(k)[i].as_py() for k in (0, 3, 4, 5))
                if kind < 0:
                    if head:
                        yield scored()
                    head, got = (b.column(1).slice(i, 1).flatten(), _sheet(b.column(2).slice(i, 1).flatten(), at, x, y)), []
                else:
                    got.append((kind, x, y))
        if head:
            yield scored()

    kind = dict(marked.dtypes)["id"]
    rows = sheets.select("piece", F.lit(-1).alias("kind"), F.lit(-1).alias("r"), "ids", "target", "at", "a", "b")
    rows = rows.unionByName(answers.where("piece >= 0").select("piece", "kind", "r", "a", "b"), allowMissingColumns=True)
    rows = rows.repartition("piece").sortWithinPartitions("piece", "kind", "r").select("kind", "ids", "target", "at", "a", "b")
    return arrow(rows, score, f"id {kind}, n_tokens long, loss_target double, loss_background double, score double")


def loss_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return difference(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id")).withColumnRenamed("id", "doc_id")
