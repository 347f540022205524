"""Aligning vectors with canonical ones: the nearest for each row, and registration in order.

The canonical side travels in blocks of ``BLOCK`` vectors; the other side, of any size, stands where it is, and a row keeps the
best that it has met. Rows without a vector stay what they are. Vectors without length are as far as any: similarity 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Canonical vectors that travel together, and blocks that a pass over the rows takes.
BLOCK, BLOCKS = 4096, 8
_STATE = "id long, embedding array<double>, tag long, similarity double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(np.stack(column.to_numpy(zero_copy_only=False)).astype(float))


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>")).filter("id IS NOT NULL AND embedding IS NOT NULL")


def nearest(rows: DataFrame, canonical: DataFrame, key: str, earlier: bool = False, block: int = BLOCK) -> DataFrame:
    """id, tag, similarity: the most similar canonical vector of each row, ties to the smaller id; ``earlier``: among those of smaller ids.

    Rows that meet none have a null tag.
    """
    named = _vectors(canonical, key)
    n_blocks = -(-named.count() // block)
    deal = F.pmod(F.xxhash64("id"), F.lit(max(1, n_blocks)))
    state = _vectors(rows, key).select("id", "embedding", F.lit(None).cast("long").alias("tag"), F.lit(None).cast("double").alias("similarity"))
    for start in range(0, n_blocks, BLOCKS):
        shared = []
        for number in range(start, min(n_blocks, start + BLOCKS)):
            some = sorted(tuple(r) for r in named.filter(deal == number).collect())
            if some:
                shared.append(rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in some]), _unit(np.array([v for _, v in some], dtype=float)))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, own = b.column("id").to_numpy(), _matrix(b.column("embedding"))
                best = b.column("similarity").to_numpy(zero_copy_only=False).astype(float)
                tag = np.array(b.column("tag").fill_null(np.iinfo(np.int64).max))
                best[np.isnan(best)] = -np.inf
                for x in shared:
                    names, units = x.value
                    s = own @ units.T
                    if earlier:
                        s[names[None, :] >= ids[:, None]] = -np.inf
                    at = s.argmax(axis=1)  # the first of equals: ids rise
                    top = s[np.arange(len(s)), at]
                    better = (top > best) | (top == best) & (names[at] < tag) & np.isfinite(top)
                    best[better], tag[better] = top[better], names[at][better]
                none = ~np.isfinite(best)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(tag, mask=none), pa.array(best, mask=none)], names=["id", "embedding", "tag", "similarity"])

        state = state.mapInArrow(run, _STATE)
        if start + BLOCKS < n_blocks:
            state = cut(state)
    return state.drop("embedding")


def _in_order(units: np.ndarray, threshold: float) -> list[int]:
    """Places of the rows that are near no row taken before them."""
    taken: list[int] = []
    held = np.empty_like(units)
    for k in range(len(units)):
        n = len(taken)
        if not n or (held[:n] @ units[k]).max() < threshold:
            held[n] = units[k]
            taken.append(k)
    return taken


def register(rows: DataFrame, key: str, threshold: float, front: int = BLOCK) -> DataFrame:
    """id, tag, similarity, registered: rows in the order of their ids, each aligned with the most similar canonical row before it
    that is similar enough, or else registered as canonical itself. The rows of an id are one.

    Whether a row is registered depends on those before it. The first ``front`` undecided rows have met all earlier canonical ones,
    so they are decided among themselves; the rows behind them meet the new ones where they stand, and those near one are decided,
    too. A round takes ``front`` rows at least, and each canonical row meets each later row twice at most, so the result is the same
    however the rows are dealt out.
    """
    spark = rows.sparkSession
    every = cut(_vectors(rows, key).dropDuplicates(["id"]))
    left, found = every, None
    while True:
        head = left.orderBy("id").limit(front).collect()
        if not head:
            break
        units = _unit(np.array([r.embedding for r in head], dtype=float))
        new = _in_order(units, threshold)
        shared = spark.sparkContext.broadcast(units[new])
        part = spark.createDataFrame([(head[k].id, head[k].embedding) for k in new], "id long, embedding array<double>")
        found = part if found is None else found.unionByName(part)

        def far(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array((_matrix(b.column("embedding")) @ shared.value.T).max(axis=1) < threshold))

        left = cut(left.filter(F.col("id") > head[-1].id).mapInArrow(far, "id long, embedding array<double>"))
    if found is None:
        return every.select("id", F.col("id").alias("tag"), F.lit(1.0).alias("similarity"), F.lit(True).alias("registered"))
    canonical = cut(found)
    met = nearest(every, canonical, "id", earlier=True)
    near = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return met.select("id", F.when(near, F.col("tag")).otherwise(F.col("id")).alias("tag"), F.when(near, F.col("similarity")).alias("similarity"), (~near).alias("registered"))
