"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building pieces.

A trie of the vocabulary gets failure links as in Song et al. 2021: where no
child fits, the pieces that greedy matching is sure of are popped (only their
number is kept, computed with the links) and matching goes on at the link's
node. Each character is read once.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach

#: Remembered word counts of a worker.
KNOWN = 400_000
KIND = "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>"
_WORDS = re.compile(r"\w+|[^\w\s]+").findall


class Automaton:
    """Counts the greedy pieces of words over a vocabulary in which ``end`` closes a word's last piece.

    Nodes are numbered; ``child[n]`` maps a character to a node, ``link[n]`` is
    the node after popping (or -1: no piece can be popped, the word is unknown)
    and ``pops[n]`` how many pieces were popped on the way.
    """

    def __init__(self, vocab, end: str = "</w>"):
        #: Every word is read with one extra character behind it that stands for ``end``.
        self.stop = "\x00"
        self.child: list[dict[str, int]] = [{}]
        self.final = [False]
        for piece in vocab:
            if not piece:
                continue
            n = 0
            for c in piece[: -len(end)] + self.stop if piece.endswith(end) and len(piece) > len(end) else piece:
                if c not in self.child[n]:
                    self.child[n][c] = len(self.child)
                    self.child.append({})
                    self.final.append(False)
                n = self.child[n][c]
            self.final[n] = True
        # the end by itself is no token: a word's last piece may be one that does not close it
        bare = self.child[0].setdefault(self.stop, len(self.child))
        if bare == len(self.child):
            self.child.append({})
            self.final.append(False)
        self.final[bare] = True
        size = len(self.child)
        self.link, self.pops = [-1] * size, [0] * size
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if self.final[v]:
                        self.link[v], self.pops[v] = 0, 0 if v == bare else 1
                        continue
                    z, n = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.child[z]:
                        n += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.child[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if greedy matching fails somewhere (then it is one unknown token)."""
        child, link, pops = self.child, self.link, self.pops
        u = n = 0
        for c in word.replace(self.stop, "�") + self.stop:
            while c not in child[u]:
                n += pops[u]
                u = link[u]
                if u < 0:
                    return 0
            u = child[u][c]
        while u > 0:
            n += pops[u]
            u = link[u]
        return n if u == 0 else 0


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies, by their published rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}


_BYTES = byte_characters()
_kept: dict[str, tuple[Automaton, dict[str, int]]] = {}


def spell(word: str) -> str:
    return word if word.isascii() else "".join([_BYTES[b] for b in word.encode()])


def loaded(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton over a vocabulary file, and the counts this worker remembers."""
    if path not in _kept:
        with open(path, encoding="utf-8") as f:
            _kept[path] = (Automaton(json.load(f)["model"]["vocab"]), {})
    return _kept[path]


def count_text(text: str, automaton: Automaton, known: dict[str, int]) -> tuple[int, int, int]:
    """Words, tokens and unknown words: lower-cased runs of letters, digits and underscores, or of other signs."""
    words = _WORDS(text.lower())
    total = unknown = 0
    for w in words:
        n = known.get(w)
        if n is None:
            if len(known) >= KNOWN:
                known.clear()
            n = known[w] = automaton.count(spell(w))
        total += n or 1
        unknown += not n
    return len(words), total, unknown


def token_counts(docs: DataFrame, vocabulary: str, text_col="text", keep=None, name="found") -> DataFrame:
    """docs with a struct of ``KIND`` from each whole text. Null and empty texts have no words; a word greedy matching can't cover is one unknown token.

    ``vocabulary`` is a file that the workers can open.
    """

    def make():
        automaton, known = loaded(vocabulary)

        def f(col):
            got = [count_text(t or "", automaton, known) for t in col.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], names=["n_words", "n_tokens", "n_unknown"])

        return f

    return attach(docs, text_col, make, KIND, keep, name)


def count_report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = token_counts(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return out.select("doc_id", F.col("found.n_words"), F.col("found.n_tokens"), F.col("found.n_unknown"))
