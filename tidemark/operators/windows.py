"""Ordered operators: sessions, count windows, running state, pruning, latest-per-group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, ts: str, tie: str, gap: str = "30 MINUTES") -> DataFrame:
    """Adds ``session`` (from 1 per key): a new one begins when more than ``gap`` passed since the row before."""
    order = W.partitionBy(key).orderBy(ts, tie)
    new = F.col(ts) - F.lag(ts).over(order) > F.expr(f"INTERVAL {gap}")
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(order)).drop("_new")


def session_rows(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Adds is_first, is_last within the session and new_day against the row before, per key."""
    order = W.partitionBy(key).orderBy(ts, tie)
    before, after = F.lag("session").over(order), F.lead("session").over(order)
    day = F.to_date(ts)
    return rows.select(
        "*",
        F.coalesce(before != F.col("session"), F.lit(True)).alias("is_first"),
        F.coalesce(after != F.col("session"), F.lit(True)).alias("is_last"),
        F.coalesce(F.lag(day).over(order) != day, F.lit(True)).alias("new_day"),
    )


def count_windows(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Adds ``bucket``: tumbling windows of ``size`` rows per key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("bucket", F.floor((n - 1) / size).cast("long"))


def context_state(position: Column, window: int, recalled: Column, drifted: Column) -> Column:
    return (
        F.when(drifted, "DRIFT").when(position >= 0.8 * window, "EVICTION").when(recalled, "RECALL").otherwise("FOCUSED")
    )


def prune(rows: DataFrame, key: str, order: list[str], cost: str, locked: str, most: int, batch: int, bucket: Column | None = None) -> DataFrame:
    """Rows that stay when the oldest unlocked ones go until ``most - batch`` units are left; only where more than ``most`` are.

    ``bucket`` rises with the order; with it no task sees a whole key.
    """
    free = F.when(~F.col(locked), F.col(cost)).otherwise(0)
    told = scanned(rows, [key], order, F.lit(0) if bucket is None else bucket, sums={"_used": free}, totals={"_total": free})
    goes = ~F.col(locked) & (F.col("_total") > most) & (F.col("_total") - (F.col("_used") - F.col(cost)) > most - batch)
    return told.filter(~goes).drop("_used", "_total")


def latest_per_group(rows: DataFrame, key: str | list[str], newest: list, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*newest))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def elastic_fold(turns: Column, decay: float) -> Column:
    """State after ordered turns: each decays it, then adds a delta and bends it into (-20, 20)."""
    return F.aggregate(turns, F.lit(0.0), lambda x, d: 20 * F.tanh((x * (1 - decay) + d) / 20))


def numbered(rows: DataFrame, key: str | None, order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """Adds the row number from 1 (per key) in the given order, without one task per key.

    ``bucket`` must rise with the order; buckets are counted, and only those counts, one row each, are summed up in order.
    """
    keys = [key] if key else []
    placed = rows.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "_bucket", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return placed.withColumn("_own", own).join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def rolling(rows: DataFrame, key: str, position: str, size: int, block: int, **values: Column) -> DataFrame:
    """Adds values over the last ``size`` rows per key; ``values`` take a window. Tasks get a block of positions and what stands before it."""
    own = F.floor((F.col(position) - 1) / block)
    late = (F.col(position) - 1) % block >= block - size + 1
    # the last rows of a block stand in front of the next one, too
    blocks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    placed = rows.withColumn("_block", F.explode(blocks)).withColumn("_context", F.col("_block") != own)
    w = W.partitionBy(key, "_block").orderBy(position).rowsBetween(1 - size, 0)
    return placed.withColumns({name: value.over(w) for name, value in values.items()}).filter("NOT _context").drop("_block", "_context")


def scanned(
    rows: DataFrame, keys: list[str], order: list, bucket: Column, sums: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
    before: dict[str, str] | None = None, after: dict[str, str] | None = None,
) -> DataFrame:
    """Adds, per key in the given order: running sums with the row's own value, sums of the whole key, and a column's value in the
    row before or after (null at the ends). Null keys are keys.

    ``order`` rises, and ``bucket`` rises with it. Only buckets meet in a task: their sums and border rows, one row each, are lined
    up by key, and rows get from there what stands outside their bucket.
    """
    sums, totals, before, after = sums or {}, totals or {}, before or {}, after or {}
    placed = rows.withColumns({"_bucket": bucket, **{f"_s_{k}": v for k, v in {**sums, **totals}.items()}})
    place = F.struct(*order)
    # names are taken as values of a struct, so that a null in the border row is not a missing one
    border = lambda columns: F.struct(F.lit(1).alias("there"), *(F.col(c).alias(f"_c_{n}") for n, c in columns.items()))
    ends = placed.groupBy(*keys, "_bucket").agg(
        *(F.sum(f"_s_{k}").alias(f"_s_{k}") for k in {**sums, **totals}), F.max_by(border(before), place).alias("_last"), F.min_by(border(after), place).alias("_first"),
    )
    line = W.partitionBy(*keys).orderBy("_bucket")
    borders = ends.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"),
        *(F.coalesce(F.sum(f"_s_{k}").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{k}") for k in sums),
        *(F.sum(f"_s_{k}").over(W.partitionBy(*keys)).alias(f"_t_{k}") for k in totals),
        F.lag("_last").over(line).alias("_last"), F.lead("_first").over(line).alias("_first"),
    )
    own = W.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = placed.withColumns({
        **{f"_r_{k}": F.sum(f"_s_{k}").over(own.rowsBetween(W.unboundedPreceding, 0)) for k in sums},
        "_prior": F.lag(border(before)).over(own), "_next": F.lead(border(after)).over(own),
    })
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return inside.join(borders, same).select(
        *(F.col(c) for c in rows.columns),
        *((F.col(f"_o_{k}") + F.coalesce(f"_r_{k}", F.lit(0))).alias(k) for k in sums), *(F.col(f"_t_{k}").alias(k) for k in totals),
        *(F.coalesce("_prior", "_last")[f"_c_{n}"].alias(n) for n in before), *(F.coalesce("_next", "_first")[f"_c_{n}"].alias(n) for n in after),
    )
