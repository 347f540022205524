"""Graph and density clustering: connected components by hooking and jumping, DBSCAN over vectors of a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

DBSCAN_SCHEMA = "session_id long, message_id long, cluster long"
#: Members of a session that are compared at once; distances are made in blocks of rows, never as a whole matrix.
BLOCK = 512


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the ends of undirected edges (u, v)."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    while True:
        label = cut(label)
        met = both.join(label.select(F.col("node").alias("v"), F.col("component").alias("other")), "v")
        near = met.groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        moved = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        hooks = moved.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("hook"))
        hooked = moved.join(hooks, "node", "left").select("node", "old", F.least("component", "hook").alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = cut(hooked.join(jump, "component").select("node", "old", F.col("next").alias("component")))
        if after.filter("component <> old").isEmpty():
            return after.select("node", "component")
        label = after.select("node", "component")


def _cluster(vectors: np.ndarray, ts: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Cluster numbers from 0; noise is one cluster, -1."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    span = max(ts.max() - ts.min(), 1e-9)

    def near(rows):
        return 1 - unit[rows] @ unit.T + 0.05 * np.abs(ts[rows, None] - ts[None, :]) / span <= eps

    degree = np.concatenate([near(np.arange(a, min(n, a + BLOCK))).sum(axis=1) for a in range(0, n, BLOCK)])
    core, out, found = degree >= min_samples, np.full(n, -1), 0
    for i in range(n):
        if not core[i] or out[i] >= 0:
            continue
        out[i], todo = found, [i]
        while todo:
            fresh = np.flatnonzero(near(np.array([todo.pop()]))[0] & (out < 0))
            out[fresh] = found
            todo += fresh[core[fresh]].tolist()
        found += 1
    return out


def dbscan(rows: DataFrame, eps: float = 0.45, min_samples: int = 2) -> DataFrame:
    """session_id, message_id, cluster. A session is a window of chat, which the close rules bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "message_id"])
        found = _cluster(np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["ts"].to_numpy(dtype=float), eps, min_samples)
        return pdf[["session_id", "message_id"]].assign(cluster=found)

    return rows.groupBy("session_id").applyInPandas(run, DBSCAN_SCHEMA)
