"""Queries of the life cycle: each returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lifecycle as O
from tidemark.operators import windows
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES, memories, table

_KEPT = ["event_id", "group_id", "status", "is_locked"]


@query(
    "SELECT event_id, group_id, CASE WHEN status = 'active' AND NOT is_locked AND s < 0.05 THEN 'archived' ELSE status END AS status, is_locked, round(s, 6) AS salience "
    "FROM (SELECT *, greatest(0.0, salience * exp(-0.01)) AS s FROM memories)",
    MEMORIES,
)
def decay_archive(spark, sf_dir):
    out = O.archive(O.decay(memories(spark, sf_dir, text=False), 0.01), 0.05)
    return out.select(*_KEPT, F.round("salience", 6).alias("salience"))


@query(
    "SELECT event_id, group_id, CASE WHEN status = 'active' AND NOT is_locked AND salience < 0.3 THEN 'archived' ELSE status END AS status, is_locked FROM memories "
    "WHERE NOT (status = 'archived' AND NOT is_locked AND start_time < 1000000)",
    MEMORIES,
)
def cleanup_two_phase(spark, sf_dir):
    return O.cleanup(memories(spark, sf_dir, text=False), 1_000_000, 0.3).select(*_KEPT)


@query(
    "SELECT event_id, group_id FROM memories WHERE NOT (NOT is_locked AND status = 'archived' AND start_time < 2000000)",
    MEMORIES,
)
def retention_expire(spark, sf_dir):
    return O.expire(memories(spark, sf_dir, text=False), 2_000_000).select("event_id", "group_id")


@query(
    """, sums AS (SELECT *, sum(CASE WHEN NOT is_locked THEN n_chars ELSE 0 END) OVER (PARTITION BY group_id) AS total,
  coalesce(sum(n_chars) OVER (PARTITION BY group_id, is_locked ORDER BY start_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM memories)
SELECT event_id, group_id FROM sums WHERE NOT (NOT is_locked AND total > 60000 AND total - before > 60000 - 5000)""",
    MEMORIES,
)
def prune_history(spark, sf_dir):
    rows = memories(spark, sf_dir, text=False)
    return windows.prune(rows, "group_id", ["start_time", "event_id"], "n_chars", "is_locked", 60_000, 5_000, F.floor(F.col("start_time") / 3_600_000)).select("event_id", "group_id")


@query(
    "SELECT event_id, is_locked, status FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN true ELSE is_locked END AS is_locked, "
    "CASE WHEN event_id % 77 = 0 THEN 'active' ELSE status END AS status FROM memories)",
    MEMORIES,
)
def patch_fields(spark, sf_dir):
    """Single-column updates: lock some rows, restore others."""
    patch = lambda when, value, column: F.when(F.expr(when), F.lit(value)).otherwise(F.col(column)).alias(column)
    return memories(spark, sf_dir, text=False).select(
        "event_id", patch("event_id % 50 = 0", True, "is_locked"), patch("event_id % 77 = 0", "active", "status")
    )


_DELTA = """delta AS (SELECT o_custkey AS c_custkey, 'n' || o_orderkey AS c_name, o_totalprice AS c_acctbal FROM orders WHERE o_orderpriority = '1-URGENT'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _delta(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    newest = O.latest(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    name = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))
    return newest.select(F.col("o_custkey").alias("c_custkey"), name.alias("c_name"), F.col("o_totalprice").alias("c_acctbal"))


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@query(
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM delta) UNION ALL SELECT * FROM delta",
    _DELTA,
)
def upsert_latest(spark, sf_dir):
    return O.upsert(_people(spark, sf_dir), _delta(spark, sf_dir), ["c_custkey"])


@query(
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM delta) UNION ALL "
    "SELECT d.c_custkey, coalesce(c.c_name, d.c_name), d.c_acctbal FROM delta d LEFT JOIN customer c USING (c_custkey)",
    _DELTA,
)
def upsert_keep_created(spark, sf_dir):
    return O.upsert_keep(_people(spark, sf_dir), _delta(spark, sf_dir), ["c_custkey"], ["c_name"])


@query(
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 UNION ALL SELECT * FROM delta WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    _DELTA,
)
def upsert_ignore(spark, sf_dir):
    return O.insert_ignore(_people(spark, sf_dir).filter("c_acctbal > 0"), _delta(spark, sf_dir), ["c_custkey"])


_ROWS = "rows_ AS (SELECT o_custkey AS k, o_orderpriority AS persona, min(o_orderkey) AS v FROM orders GROUP BY ALL)"


def _persona_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("persona")).agg(F.min("o_orderkey").alias("v"))


@query(
    "SELECT k, persona, v FROM rows_ WHERE persona <> '5-LOW' UNION ALL SELECT k, '1-URGENT', v FROM rows_ r WHERE persona = '5-LOW' "
    "AND NOT EXISTS (SELECT 1 FROM rows_ t WHERE t.k = r.k AND t.persona = '1-URGENT')",
    _ROWS,
)
def merge_target_wins(spark, sf_dir):
    return O.merge_persona(_persona_rows(spark, sf_dir), "persona", "5-LOW", "1-URGENT", ["k"])


@query(
    "SELECT count(*) FILTER (NOT own) AS moved, count(*) FILTER (own) AS dropped FROM (SELECT EXISTS (SELECT 1 FROM rows_ t WHERE t.k = r.k AND t.persona = '1-URGENT') AS own "
    "FROM rows_ r WHERE persona = '5-LOW')",
    _ROWS,
)
def merge_preview(spark, sf_dir):
    out = O.merge_preview(_persona_rows(spark, sf_dir), "persona", "5-LOW", "1-URGENT", ["k"])
    return out.select(F.col("moved").cast("long").alias("moved"), F.col("dropped").cast("long").alias("dropped"))


@query(
    "SELECT 'persona' AS kind, c_custkey AS id FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'binding', o_orderkey FROM orders "
    "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"
)
def cascade_delete(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    gone = people.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    stay = people.filter("c_nationkey <> 3").select(F.lit("persona").alias("kind"), F.col("c_custkey").alias("id"))
    bindings = table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti")
    return stay.unionByName(bindings.select(F.lit("binding").alias("kind"), F.col("o_orderkey").alias("id")))


