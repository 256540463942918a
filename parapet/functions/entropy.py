"""Shannon entropy of the characters of a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from parapet.functions.signatures import ENTROPY_LEVELS, ENTROPY_MIN_CHARS


#: Characters below this number are counted into an array, others by sorting.
DENSE = 1 << 16


def text_entropy(text: str) -> float:
    """With counts c of n characters the entropy is ``log2(n) - sum(c * log2(c)) / n``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return 0.0
    counts = np.bincount(codes) if codes.max() < DENSE else np.unique(codes, return_counts=True)[1]
    counts = counts[counts > 0].astype(np.float64)
    return float(np.log2(len(codes)) - (counts * np.log2(counts)).sum() / len(codes))


@F.pandas_udf(DoubleType())
def char_entropy(texts: pd.Series) -> pd.Series:
    """Bits per character, 0 for null. One pass over the text whatever its alphabet, and no
    shuffle of single characters."""
    return texts.fillna("").map(text_entropy).astype("float64")


def entropy_score(text: Column) -> Column:
    """0 below the minimum length, else the score of the first level that is exceeded."""
    entropy = char_entropy(text)
    return F.when(F.length(text) < ENTROPY_MIN_CHARS, 0).otherwise(level_score(entropy))


def level_score(entropy: Column) -> Column:
    (high, high_score), (low, low_score) = ENTROPY_LEVELS
    return F.when(entropy > high, high_score).when(entropy > low, low_score).otherwise(0)
