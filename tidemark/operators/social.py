"""The social graph: pairs of people who met, smoothed impressions, assembled and paired edges, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions import circumplex as C
from tidemark.operators.windows import latest_per_group


#: Members of an event that meet in one task, pairs that a task makes of such events, and the most tasks for either.
BLOCK, PER_TASK, MOST_TASKS = 2000, 1_000_000, 10_000
#: Pairs of members, about, that the newest events are to have when pairs are looked for that need no older ones; the most of those pairs.
SLICE, MOST_FULL = 4_000_000, 20_000


def _counts(members: DataFrame) -> DataFrame:
    return members.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


def _sums(members: DataFrame, block: int) -> Row:
    """n_pairs of blocks in large events, n_small pairs of members in others, n_met in all; the least and largest event."""
    n, blocks = F.col("n"), F.ceil(F.col("n") / block)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return _counts(members).agg(
        total(F.when(n > block, blocks * blocks)).alias("n_pairs"), total(F.when(n <= block, n * n)).alias("n_small"), total(n * n).alias("n_met"),
        F.min("event_id").alias("low"), F.max("event_id").alias("high"),
    ).first()


def pairs(members: DataFrame, directed: bool = True, block: int = BLOCK, per_task: int = PER_TASK, sums: Row | None = None) -> DataFrame:
    """event_id, observer, subject: who met whom.

    Events are dealt to as many tasks as their pairs need, about ``per_task`` each. The members of an event with more than ``block``
    are dealt into blocks, and pairs of blocks meet, so a large event is the work of many tasks.
    """
    apart = F.col("observer") != F.col("subject") if directed else F.col("observer") < F.col("subject")
    blocks = F.ceil(F.col("n") / block)
    sizes = _counts(members).filter(F.col("n") > block)
    n_pairs, n_small, *_ = sums or _sums(members, block)
    small = members.join(sizes, "event_id", "left_anti") if n_pairs else members
    # a few members are little to read and many pairs to tell, so tasks are not made by what they read
    small = small.filter("event_id IS NOT NULL AND uid IS NOT NULL").repartition(max(1, min(MOST_TASKS, -(-n_small // per_task))), "event_id")
    a, b = (small.select("event_id", F.col("uid").alias(name)) for name in ("observer", "subject"))
    met = a.join(b, "event_id").filter(apart)
    if not n_pairs:
        return met
    tasks = min(MOST_TASKS, n_pairs)
    large = members.join(sizes, "event_id").select("event_id", "uid", F.pmod(F.xxhash64("uid"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    c = large.select("event_id", F.col("uid").alias("observer"), F.col("own").alias("_i"), F.col("other").alias("_j"))
    d = large.select("event_id", F.col("uid").alias("subject"), F.col("other").alias("_i"), F.col("own").alias("_j"))
    dealt = (x.repartition(tasks, "event_id", "_i", "_j") for x in (c, d))
    return met.unionByName(next(dealt).join(next(dealt), ["event_id", "_i", "_j"]).filter(apart).drop("_i", "_j"))


def shared_events(members: DataFrame, directed: bool = True) -> DataFrame:
    """observer, subject, shared."""
    return pairs(members, directed).groupBy("observer", "subject").agg(F.count(F.lit(1)).alias("shared"))


def newest_shared(members: DataFrame, most: int, directed: bool = True, size: int = SLICE) -> DataFrame:
    """event_id, observer, subject: the newest ``most`` shared events of every pair; newer ones have larger ids, which are numbers.

    Pairs that met often enough in the newest events leave out the older ones, before anything is sorted. Which events these are
    (about ``size`` pairs) is a matter of cost only.
    """
    sums = _sums(members, BLOCK)
    met = pairs(members, directed, sums=sums)
    if sums.n_met > 2 * size:
        since = sums.high - (sums.high - sums.low) * size // sums.n_met
        late = pairs(members.filter(F.col("event_id") >= since), directed)
        full = late.groupBy("observer", "subject").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).limit(MOST_FULL)
        full = F.broadcast(full.select("observer", "subject"))  # at most MOST_FULL rows
        met = met.filter(F.col("event_id") < since).join(full, ["observer", "subject"], "left_anti").unionByName(late)
    return latest_per_group(met.select("event_id", "observer", "subject"), ["observer", "subject"], [F.col("event_id").desc()], most)


def derived(b: Column, p: Column) -> list[Column]:
    return [C.octant(b, p).alias("orientation"), C.intensity(b, p).alias("intensity"), C.fit(b, p).alias("fit")]


def smooth(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], alpha: float = 0.4) -> DataFrame:
    """Upsert of edges: what exists moves by alpha towards the new value, what doesn't is the new value."""
    before = old.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(v).alias(f"_old_{v}") for v in values), F.lit(True).alias("_old"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    joined = before.join(new.withColumn("_new", F.lit(True)), same, "full")
    return joined.select(
        *(F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_key_{k}")).alias(k) for k in keys),
        *(F.coalesce(C.ema(F.col(v), F.col(f"_old_{v}"), alpha), F.col(v), F.col(f"_old_{v}")).alias(v) for v in values),
    )


def reanalyze(shared: DataFrame) -> DataFrame:
    """Heuristic benevolence and power of every pair from its shared events."""
    salience = F.least(F.lit(1.0), 0.3 + 0.05 * F.col("shared"))
    b, p = C.heuristic(F.col("shared"), salience)
    return shared.withColumns({"benevolence": b, "power": p})


def mutual(edges: DataFrame, weight: float = 1.2) -> DataFrame:
    """u < v with both directions of an edge list (observer, subject, intensity, n), one row a pair."""
    u, v = F.least("observer", "subject"), F.greatest("observer", "subject")
    forward = F.col("observer") < F.col("subject")
    both = edges.groupBy(u.alias("u"), v.alias("v")).agg(
        F.max(F.when(forward, F.col("intensity"))).alias("forward"),
        F.max(F.when(~forward, F.col("intensity"))).alias("backward"),
        F.sum("n").alias("messages"),
    )
    two = F.col("forward").isNotNull() & F.col("backward").isNotNull()
    affinity = F.when(two, (F.col("forward") + F.col("backward")) * weight).otherwise(F.coalesce("forward", "backward"))
    return both.select("u", "v", two.alias("mutual"), affinity.alias("affinity"), "messages")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def ego(edges: DataFrame, node: int) -> DataFrame:
    """Edges at a node, and the neighbour of each."""
    out = edges.filter(F.col("u") == node).select(F.col("v").alias("neighbour"))
    return out.unionByName(edges.filter(F.col("v") == node).select(F.col("u").alias("neighbour"))).distinct()


def radius(n: Column, low: Column, high: Column, smallest: float = 12.0, largest: float = 22.0) -> Column:
    """Between the smallest and the largest by n's place between low and high; the middle if they are one."""
    share = (n - low) / F.nullif(high - low, F.lit(0))
    return F.coalesce(smallest + (largest - smallest) * share, F.lit((smallest + largest) / 2))
