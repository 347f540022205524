"""Life cycle of stored rows: snapshots in, snapshots out. Parquet has no MERGE; each function is one new version."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keys(rows: DataFrame, keys: list[str], also: list[Column] = ()) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *also)


def _same(keys: list[str], folds: tuple[str, ...] = ()) -> Column:
    """Keys are equal, null with null; in ``folds`` (personas) also null with the empty text."""
    own = lambda name, k: F.coalesce(name, F.lit("")) if k in folds else F.col(name)
    return reduce(lambda a, b: a & b, (own(k, k).eqNullSafe(own(f"_key_{k}", k)) for k in keys))


def without(rows: DataFrame, others: DataFrame, keys: list[str], folds: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose keys ``others`` doesn't have; null is a key like any other."""
    return rows.join(_keys(others, keys), _same(keys, folds), "left_anti")


def latest(delta: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the newest."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
    return delta.withColumn("_n", n).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, delta: DataFrame, keys: list[str], folds: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``delta``, which has one per key, replace rows of ``old``."""
    return without(old, delta, keys, folds).unionByName(delta)


def upsert_keep(old: DataFrame, delta: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Like ``upsert``, but columns ``keep`` stay as they were where the row existed."""
    before = _keys(old, keys, [F.col(c).alias(f"_{c}") for c in keep])
    merged = delta.join(before, _same(keys), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns))
    return without(old, delta, keys).unionByName(merged)


def insert_ignore(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(without(delta, old, keys))


def decay(rows: DataFrame, rate: float) -> DataFrame:
    return rows.withColumn("salience", F.greatest(F.lit(0.0), F.col("salience") * math.exp(-rate)))


def archive(rows: DataFrame, below: float) -> DataFrame:
    """Active, unlocked rows under the threshold become archived."""
    low = (F.col("status") == "active") & ~F.col("is_locked") & (F.col("salience") < below)
    return rows.withColumn("status", F.when(low, "archived").otherwise(F.col("status")))


def expire(rows: DataFrame, before: float) -> DataFrame:
    """Without archived, unlocked rows from before a time."""
    return rows.filter(~((F.col("status") == "archived") & ~F.col("is_locked") & (F.col("start_time") < before)))


def cleanup(rows: DataFrame, before: float, below: float) -> DataFrame:
    """Expires old archives first and archives afterwards, so what is archived now outlives this run."""
    return archive(expire(rows, before), below)


def _owned(persona: str, owner: str | None) -> Column:
    return F.coalesce(persona, F.lit("")) == F.lit(owner or "")


def merge_persona(rows: DataFrame, persona: str, source: str | None, target: str | None, keys: list[str]) -> DataFrame:
    """Rows of the source persona move to the target, unless the target has a row with the same keys: then they go.

    Source and target may be null, which stands for rows from before there were personas; as a target it is the empty text, too.
    """
    own = rows.filter(_owned(persona, target) & ~F.col(persona).eqNullSafe(source))
    moving = without(rows.filter(F.col(persona).eqNullSafe(source)), own, keys).withColumn(persona, F.lit(target).cast("string"))
    return rows.filter(~F.col(persona).eqNullSafe(source)).unionByName(moving.select(*rows.columns))


def merge_preview(rows: DataFrame, persona: str, source: str | None, target: str | None, keys: list[str]) -> DataFrame:
    """One row: how many rows a merge would move and drop."""
    own = _keys(rows.filter(_owned(persona, target) & ~F.col(persona).eqNullSafe(source)), keys).distinct().withColumn("_own", F.lit(True))
    moving = rows.filter(F.col(persona).eqNullSafe(source)).join(own, _same(keys), "left")
    count = lambda when: F.coalesce(F.sum(F.when(when, 1).otherwise(0)), F.lit(0))
    return moving.agg(count(F.col("_own").isNull()).alias("moved"), count(F.col("_own")).alias("dropped"))
