"""Tables of a folder, and views of them as memories, messages, members and impressions.

Each view has its SQL beside it: the queries' SQL names these views in its WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that meet in a task.
ROWS = 250_000


def dealt(rows: DataFrame, *keys: str, others: tuple[DataFrame, ...] = ()) -> DataFrame | list[DataFrame]:
    """``rows`` by ``keys``, in as many tasks as their number needs, so a task's memory doesn't grow with the table; ``others`` likewise, to be joined."""
    tasks = max(1, -(-rows.count() // ROWS))
    found = [x.repartition(tasks, *keys) for x in (rows, *others)]
    return found if others else found[0]


def memories(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """Documents as memories: one hour per id, salience from the length, archived if toxic, a third without a parent, others after one of the five ids before."""
    labels = table(spark, sf_dir, "labels")
    before = F.col("doc_id") - 1 - F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents").withColumn("parent", F.when((F.col("doc_id") % 3 != 0) & (before >= 0), before))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("event_id"),
        F.col("source").alias("group_id"),
        "lang",
        *(["text"] if text else []),
        "n_chars",
        F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("salience"),
        F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"),
        F.coalesce((F.col("quality") == 1) & (F.col("doc_id") % 10 == 0), F.lit(False)).alias("is_locked"),
        (F.col("doc_id") * 3600).cast("double").alias("start_time"),
        F.when(F.col("doc_id") % 7 == 0, "narrative").otherwise("episode").alias("event_type"),
        "parent",
    )


MEMORIES = """memories AS (
  SELECT d.doc_id AS event_id, d.source AS group_id, d.lang, d.text, d.n_chars,
         least(1.0::DOUBLE, d.n_chars / 5000.0::DOUBLE) AS salience,
         CASE WHEN l.toxic = 1 THEN 'archived' ELSE 'active' END AS status,
         coalesce(l.quality = 1 AND d.doc_id % 10 = 0, false) AS is_locked,
         (d.doc_id * 3600)::DOUBLE AS start_time,
         CASE WHEN d.doc_id % 7 = 0 THEN 'narrative' ELSE 'episode' END AS event_type,
         CASE WHEN d.doc_id % 3 <> 0 AND d.doc_id - 1 - d.doc_id % 5 >= 0 THEN d.doc_id - 1 - d.doc_id % 5 END AS parent
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who took part in what: suppliers of an order."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("uid"))
    return dealt(line, "event_id", "uid").distinct()


MEMBERS = "members AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS uid FROM lineitem)"


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges: what a customer's nation thinks of a supplier's, per ship mode of affairs (return flag).

    Benevolence and power are scaled sums of whole numbers, so they don't depend on the order of adding.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line, orders = dealt(line, "l_orderkey", others=(orders,))
    per_pair = (
        line.join(orders, "l_orderkey")
        .groupBy((F.col("o_custkey") % 40).alias("observer"), (F.col("l_suppkey") % 40).alias("subject"), F.col("l_returnflag").alias("scope"))
        .agg(
            F.sum(F.col("l_quantity").cast("long")).alias("q"),
            F.sum(F.col("l_linenumber").cast("long")).alias("l"),
            F.count(F.lit(1)).alias("n"),
            F.max("l_orderkey").alias("last_event"),
        )
        .filter("observer <> subject")
    )
    return per_pair.select(
        "observer",
        "subject",
        "scope",
        "n",
        "last_event",
        ((F.col("q") % 201 - 100) / 100.0).alias("benevolence"),
        ((F.col("l") * 7 % 201 - 100) / 100.0).alias("power"),
        ((F.col("q") + F.col("l")) % 101 / 100.0).alias("confidence"),
    )


IMPRESSIONS = """impressions AS (
  SELECT observer, subject, scope, n, last_event, (q % 201 - 100) / 100.0::DOUBLE AS benevolence,
         (l * 7 % 201 - 100) / 100.0::DOUBLE AS power, ((q + l) % 101) / 100.0::DOUBLE AS confidence
  FROM (SELECT o_custkey % 40 AS observer, l_suppkey % 40 AS subject, l_returnflag AS scope,
               sum(l_quantity::BIGINT)::BIGINT AS q, sum(l_linenumber)::BIGINT AS l, count(*) AS n, max(l_orderkey) AS last_event
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
  WHERE observer <> subject
)"""
