"""Hashed term-frequency vectors and the surface for a user's own embedder."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

DIMENSIONS = 64


def tokens(text: Column) -> Column:
    """Runs of letters and digits; an empty string may come first or last."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def token_bucket(token: str) -> int:
    """0..63 from the first two hex digits of the token's MD5."""
    return md5(token.encode(), usedforsecurity=False).digest()[0] % DIMENSIONS


def term_counts(lists: pa.Array) -> np.ndarray:
    """Occurrences per bucket, one row per list of tokens; a null list has none.

    A batch repeats most of its tokens, so only distinct ones are hashed.
    """
    coded = lists.flatten().dictionary_encode()
    bucket = np.array([token_bucket(t) if t else -1 for t in coded.dictionary.to_pylist()], np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    own = bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    at = (row * DIMENSIONS + own)[own >= 0]
    return np.bincount(at, minlength=len(lists) * DIMENSIONS).reshape(-1, DIMENSIONS)


@F.arrow_udf(ArrayType(DoubleType()))
def _unit_counts(lists: pa.Array) -> pa.Array:
    counts = term_counts(lists).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    scaled = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, scaled.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(scaled.reshape(-1)))


def hashed_embedding(text: Column) -> Column:
    """Term counts by bucket, scaled to length one; without terms all are zero."""
    return _unit_counts(tokens(text))


def embedder(model: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Column function around a user's batch model that maps texts to lists of floats."""
    return F.pandas_udf(model, ArrayType(FloatType()))
