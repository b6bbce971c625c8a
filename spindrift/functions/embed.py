"""The offline embedder: signed feature hashing of lexical tokens, at length 1. Stands in for a model; a pandas UDF of one fits the same place."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .runs import runs

DIMS = 256


def hashed(text, dims: int = DIMS):
    """A unit vector of ``dims`` doubles; texts without tokens get zeros. A token's hash is 48 bits of its md5, so that any engine can repeat it; a batch's distinct tokens are hashed once."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def f(low: pa.Array) -> pa.Array:
        size, tokens = runs(low)
        coded = tokens.dictionary_encode()
        h = np.array([int(md5(t.encode(), usedforsecurity=False).hexdigest()[:12], 16) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        at = np.repeat(np.arange(len(size)), size) * dims + h % dims
        v = np.bincount(at, np.where((h // dims) % 2 == 1, -1.0, 1.0), len(size) * dims).reshape(len(size), dims)
        length = np.sqrt((v * v).sum(1, keepdims=True))
        v = v / np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * np.int32(dims)), pa.array(v.ravel()))

    return f(F.lower(F.col(text) if isinstance(text, str) else text))


_models: dict = {}


def model(name: str, load):
    """The model of this name in this Python worker: ``load(name)`` runs once a worker and name, not once a batch."""
    if name not in _models:
        _models[name] = load(name)
    return _models[name]


def encoded(name: str, load):
    """An embedder (a function from a text column to unit vectors) by a model: ``load(name)`` gives a function from a list of texts to vectors."""

    def embedder(text):
        @F.pandas_udf(ArrayType(DoubleType()))
        def f(texts: pd.Series) -> pd.Series:
            v = np.asarray(model(name, load)([t or "" for t in texts]), np.float64).reshape(len(texts), -1)
            return pd.Series(list(v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)), dtype=object)

        return f(F.col(text) if isinstance(text, str) else text)

    return embedder
