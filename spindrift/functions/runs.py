"""Lexical tokens of Arrow arrays of lower-cased texts, a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each text, all tokens in order): what ``text.lexical_tokens`` gives of texts that are lower-cased already; null has none."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    first[heads] |= word[heads]  # a text's first sign is no part of the text before
    starts = np.flatnonzero(first)
    cuts = np.append(np.cumsum(word, dtype=np.int64)[starts] - 1, word.sum()).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data[word]))
    return np.diff(np.searchsorted(starts, at)), tokens
