"""Operator 1: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order (bucket, doc_id, size, crc), where the bucket is a hash of the three, so ids with
a stride or without a value spread like any others; no task sees more than its buckets, and the bucket offsets are at
most ``buckets`` numbers. A row's permuted number p gives shard ``p % shards`` and slot ``p // shards``, so shard sizes differ by
one row at most (law ``rows``), slots have no gaps, and ``row_number`` computes the way back.

Defined cases: a null text has size 1 and the CRC of no bytes; a null doc_id comes first in its bucket; rows
that agree in doc_id, size and CRC are counted before the shuffle and get consecutive numbers; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
#: Numbers that a row is told for at once.
RUN = 10_000
KEYS = (0x3C6EF372, 0x1B873593, 0x2545F491, 0x41C64E6D)
ROUNDS = len(KEYS)


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds 0..n-1."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(r, key: int, mask: int):
    """Feistel round function; r and key are below 2**31, so the product fits 63 bits."""
    x = (r + 1) * key
    return ((x >> 13) ^ (x >> 29) ^ x) & mask


def feistel(p, n: int, inverse: bool = False):
    """One pass over the whole power-of-four domain; a bijection whatever the round function does."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    left, right = p >> bits, p & mask
    if inverse:
        for key in reversed(KEYS):
            left, right = right ^ _round(left, key, mask), left
    else:
        for key in KEYS:
            left, right = right, left ^ _round(right, key, mask)
    return (left << bits) | right


def permute(rows, n: int, inverse: bool = False) -> np.ndarray:
    """Bijection of 0..n-1: numbers that leave the range walk on along their cycle until they are back in it."""
    p = feistel(np.asarray(rows, dtype=np.int64), n, inverse)
    while (out := p >= n).any():
        p[out] = feistel(p[out], n, inverse)
    return p


def row_number(shard: int, slot: int, shards: int, n: int) -> int:
    """The global row number that stands at this place."""
    return int(permute(np.array([slot * shards + shard]), n, inverse=True)[0])


def numbered(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, row_no, copies, first: one row per distinct (doc_id, size, CRC), and the row count."""
    rows = (
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
        .groupBy("bucket", "doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # at most `buckets` sums, whatever the size of the table
    sums = sorted((r.bucket, r.n) for r in rows.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())
    offsets, n = [], 0
    for bucket, count in sums:
        offsets.append((bucket, n))
        n += count
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.sparkSession.createDataFrame(offsets, "bucket int, offset long")
    return rows.withColumn("before", before).join(F.broadcast(starts), "bucket").select(
        "doc_id", "size", "text_crc32", "copies", (F.col("offset") + F.col("before")).alias("first")
    ), n


def assign(docs: DataFrame, shards: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, row_no, permuted, shard, slot: one row per input row."""
    rows, n = numbered(docs, buckets)

    @F.pandas_udf("long")
    def permuted(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n))

    # rows alike in all three are spread before they are told one by one
    own, last = ["doc_id", "size", "text_crc32"], F.col("first") + F.col("copies") - 1
    parts = rows.filter(F.col("copies") > RUN).select(*own, F.explode(F.sequence("first", last, F.lit(RUN))).alias("first"), last.alias("last"))
    dealt = parts.repartition("first").withColumn("last", F.least("last", F.col("first") + RUN - 1))
    runs = rows.filter(F.col("copies") <= RUN).select(*own, "first", last.alias("last")).unionByName(dealt)
    return (
        runs.select(*own, F.explode(F.sequence("first", "last")).alias("row_no"))
        .withColumn("permuted", permuted("row_no"))
        .withColumn("shard", (F.col("permuted") % shards).cast("int"))
        .withColumn("slot", F.expr(f"permuted div {int(shards)}"))
    )

