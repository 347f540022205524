"""Queries of changes that touch several tables at once: the tables are put into a store, changed there, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import memory as M
from tidemark.operators.lineage import shared_folder
from tidemark.plans.registry import query
from tidemark.sources.store import Change
from tidemark.sources.tables import IMPRESSIONS, impressions, table

_PERSONA = "CASE WHEN {0} % 3 > 0 THEN 'p' || ({0} % 3) END"
_HELD = f"""held_events AS (SELECT doc_id AS event_id, source AS group_id, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS salience, {_PERSONA.format("doc_id")} AS persona FROM documents),
held_people AS (SELECT c_custkey::VARCHAR AS uid, c_name AS name, {_PERSONA.format("c_custkey")} AS persona FROM customer),
held_edges AS (SELECT observer % 8 AS o, subject AS s, scope, {_PERSONA.format("observer")} AS persona, max(benevolence) AS b FROM impressions GROUP BY ALL)"""


def _persona(column: str):
    return F.when(F.col(column) % 3 > 0, F.concat(F.lit("p"), (F.col(column) % 3).cast("string"))).alias("bot_persona_name")


def _filled(spark, sf_dir) -> M.Store:
    """Documents as events, their embeddings, edges between nations, customers with a binding: one version."""
    store = M.open_store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    salience = F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("salience")
    edges = impressions(spark, sf_dir).select((F.col("observer") % 8).cast("string").alias("observer_uid"), F.col("subject").cast("string").alias("subject_uid"), "scope", _persona("observer"), "benevolence")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("primary_name"), _persona("c_custkey"))
    store.commit({
        "events": Change(put=table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("group_id"), salience, _persona("doc_id"))),
        "vectors": Change(put=table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")),
        "impressions": Change(put=edges.groupBy("observer_uid", "subject_uid", "scope", "bot_persona_name").agg(F.max("benevolence").alias("benevolence"))),
        "personas": Change(put=people),
        "bindings": Change(put=people.select(F.lit("chat").alias("platform"), F.concat(F.lit("c"), "uid").alias("physical_id"), "uid")),
    })
    return store


@query(
    """SELECT event_id, group_id, v.x FROM held_events LEFT JOIN (SELECT vec_id AS event_id, round(CASE WHEN vec_id % 5 = 0 THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 9) AS x FROM embeddings
  UNION ALL SELECT doc_id, 0.5 FROM documents WHERE doc_id % 10 = 3 AND doc_id NOT IN (SELECT vec_id FROM embeddings)) v USING (event_id) WHERE event_id % 7 <> 0""",
    IMPRESSIONS, _HELD,
)
def vector_upsert(spark, sf_dir):
    """Vectors are replaced and added for events that exist; some events go with theirs. Others get no vector, and empty ones change none."""
    store = _filled(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    twice = vectors.filter("event_id % 5 = 0").select("event_id", F.transform("embedding", lambda x: 2 * x.cast("double")).alias("embedding"))
    lost = vectors.select((-1 - F.col("event_id")).alias("event_id"), F.col("embedding").cast("array<double>"))
    none = vectors.filter("event_id % 5 = 1").select("event_id", F.array().cast("array<double>").alias("embedding"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    new = documents.filter("event_id % 10 = 3").join(vectors, "event_id", "left_anti").select("event_id", F.array(F.lit(0.5)).alias("embedding"))
    M.upsert_vectors(store, twice.unionByName(lost).unionByName(none).unionByName(new))
    M.delete_events(store, documents.filter("event_id % 7 = 0"))
    held = store.read("vectors").select("event_id", F.round(F.element_at("embedding", 1), 9).alias("x"))
    return store.read("events").join(held, "event_id", "left").select("event_id", "group_id", "x")


_MERGED = """, edges AS (SELECT * FROM held_edges e WHERE persona IS DISTINCT FROM 'p2' UNION ALL SELECT o, s, scope, 'p1', b FROM held_edges e WHERE persona = 'p2'
  AND NOT EXISTS (SELECT 1 FROM held_edges t WHERE (t.o, t.s, t.scope) = (e.o, e.s, e.scope) AND t.persona = 'p1'))"""


def _told(store: M.Store):
    counts = [store.read(name).groupBy(F.lit(name).alias("held"), "bot_persona_name").agg(F.count(F.lit(1)).alias("n"), value.alias("total")) for name, value in (
        ("events", F.sum("event_id").cast("double")), ("personas", F.sum(F.col("uid").cast("long")).cast("double")), ("impressions", F.round(F.sum("benevolence"), 6)),
    )]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    _MERGED + """ SELECT 'events' AS held, CASE WHEN persona = 'p2' THEN 'p1' ELSE persona END AS bot_persona_name, count(*) AS n, sum(event_id)::DOUBLE AS total FROM held_events GROUP BY ALL
UNION ALL SELECT 'personas', CASE WHEN persona = 'p2' THEN 'p1' ELSE persona END, count(*), sum(uid::BIGINT)::DOUBLE FROM held_people GROUP BY ALL
UNION ALL SELECT 'impressions', persona, count(*), round(sum(b), 6) FROM edges GROUP BY ALL""",
    IMPRESSIONS, _HELD,
)
def persona_merge_all(spark, sf_dir):
    """One persona is merged into another in events, people and impressions, where the target's own edges stay."""
    store = _filled(spark, sf_dir)
    M.merge_personas(store, "p2", "p1")
    return _told(store)


@query(
    _MERGED + """ SELECT 'events' AS held, persona AS bot_persona_name, count(*) AS n, sum(event_id)::DOUBLE AS total FROM held_events GROUP BY ALL
UNION ALL SELECT 'personas', persona, count(*), sum(uid::BIGINT)::DOUBLE FROM held_people GROUP BY ALL UNION ALL SELECT 'impressions', persona, count(*), round(sum(b), 6) FROM edges GROUP BY ALL""",
    IMPRESSIONS, _HELD,
)
def persona_merge_impressions(spark, sf_dir):
    """The same for impressions only."""
    store = _filled(spark, sf_dir)
    M.merge_personas(store, "p2", "p1", "impressions_only")
    return _told(store)


@query(
    """SELECT o::VARCHAR AS observer_uid, s::VARCHAR AS subject_uid, scope, persona AS bot_persona_name FROM held_edges
WHERE NOT (scope = 'A' AND s % 4 = 0) AND NOT (scope = 'N' AND s % 4 = 1 AND persona IS NULL) AND NOT (scope = 'R' AND s % 4 = 2 AND persona IS NOT DISTINCT FROM 'p1')""",
    IMPRESSIONS, _HELD,
)
def impression_delete(spark, sf_dir):
    """Edges go for all personas, for those from before there were any, or for one."""
    store = _filled(spark, sf_dir)
    edges = store.read("impressions").select("observer_uid", "subject_uid", "scope").distinct()
    some = lambda scope, k: edges.filter((F.col("scope") == scope) & (F.col("subject_uid").cast("int") % 4 == k))
    M.delete_impressions(store, some("A", 0))
    M.delete_impressions(store, some("N", 1), "")
    M.delete_impressions(store, some("R", 2), "p1")
    return store.read("impressions").select("observer_uid", "subject_uid", "scope", "bot_persona_name")
