"""Signed feature hashing of words, character triples and word pairs; stands in for a text embedder."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of the three kinds of feature, and the dimension.
WORD, TRIPLE, PAIR, DIM = 1.6, 0.55, 1.15, 256


def _features(text: str):
    words = re.findall(r"\w+", text)
    for w in words:
        yield f"w:{w}", WORD
        yield from ((f"c3:{w[i : i + 3]}", TRIPLE) for i in range(len(w) - 2))
    yield from ((f"bg:{a}_{b}", PAIR) for a, b in zip(words, words[1:]))


def embed(text: str | None, dim: int = DIM) -> np.ndarray:
    v = np.zeros(dim)
    for name, weight in _features(unicodedata.normalize("NFC", text or "").strip().casefold()):
        h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        v[h % dim] += -weight if h >> 32 & 1 else weight
    n = np.sqrt(v @ v)
    return v / n if n > 1e-12 else np.zeros(dim)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ngram_vector(s: pd.Series) -> pd.Series:
    return s.map(lambda t: embed(t).tolist())
