"""Embedders: functions from a batch of texts to vectors, run as Arrow UDFs.

The default hashes words to signed places and normalises; `embedder` wraps any other model the same way.
Words are what stands between blanks, tabs and line ends, as in functions.text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64
NAME = f"hashing-{DIMENSIONS}"
WORD = re.compile(rb"[^ \t\n\r]+")


def hashing(texts: list[str]) -> np.ndarray:
    """One vector of length 1 for each text; zeros for a text without words. Where all words cancel out, the first stands for all."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        h = np.fromiter((zlib.crc32(w) for w in WORD.findall(text.lower().encode())), np.int64)
        sign = 1 - 2 * (h // DIMENSIONS % 2)
        np.add.at(row, h % DIMENSIONS, sign)
        if len(h) and not row.any():
            row[h[0] % DIMENSIONS] = sign[0]
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def embedder(model: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function array<double> from a model; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model(texts.fillna("").tolist())))

    return embed


def hash_embedding(c: Column) -> Column:
    return embedder(hashing)(c)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))
