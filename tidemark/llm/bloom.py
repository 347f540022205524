"""A Bloom filter over 64-bit keys, made by tasks and sent to all of them.

It takes ``BITS`` bits a key, between ``LEAST`` and ``MOST`` words of 64 bits (64 MB): beyond 33 million keys it lets more
others pass, which costs work and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, PLACES = 16, 4
LEAST, MOST = 1 << 14, 1 << 23


def words_for(n: int) -> int:
    """A power of two."""
    return min(MOST, max(LEAST, 1 << (n * BITS // 64).bit_length()))


def _places(key: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys (signed 64-bit hashes)."""
    k = key.astype(np.int64).view(np.uint64)
    step = (k >> np.uint64(17)) | np.uint64(1)
    for n in range(PLACES):
        yield (k + np.uint64(n) * step) % np.uint64(64 * words)


def build(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of the column ``key`` of about ``n`` rows: one array, whatever the number of rows."""
    words = words_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] | np.ndarray = np.empty(0, dtype=np.uint64)
        for b in batches:
            own = np.concatenate(list(_places(b.column("key").to_numpy(), words)))
            found = np.unique(np.concatenate([found, own]))
        at = (found >> np.uint64(6)).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        bits = np.uint64(1) << (found & np.uint64(63))
        joined = np.bitwise_or.reduceat(bits, starts) if len(at) else bits
        yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(joined.view(np.int64))], names=["at", "bits"])

    out = np.zeros(words, dtype=np.int64)
    for b in keys.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[b.column("at").to_numpy()] = b.column("bits").to_numpy()
    return out


def may_hold(spark, bloom: np.ndarray):
    """A function of a key column: false only for keys that are not there."""
    shared, words = spark.sparkContext.broadcast(bloom), len(bloom)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        found = np.ones(len(key), dtype=bool)
        for place in _places(key.to_numpy(), words):
            found &= (shared.value.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(found)

    return lambda key: maybe(key)


def column(docs: DataFrame, keys: DataFrame, n: int, key: Column) -> Column:
    return may_hold(docs.sparkSession, build(keys, n))(key)
