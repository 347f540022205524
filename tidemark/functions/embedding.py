"""Encoders of text as vectors: any batch function, run on Arrow batches, and one that hashes words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DIM = 64


def encoder(encode: Callable[[list[str]], np.ndarray]):
    """A column function text -> array<float>; nulls count as empty texts. Batches are those of Arrow."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), dtype=np.float32)))

    return run


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed counts of hashed words, of unit length: the same everywhere, without a model. Empty texts are zero."""
    import xxhash

    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in text.lower().split()], dtype=np.uint64)
        np.add.at(row, (h % np.uint64(dim)).astype(int), np.where(h >> np.uint64(63), -1.0, 1.0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
