"""Changes of a memory that touch several tables at once: events with their vectors, people with their bindings, personas.

Each is one version of a ``Store`` with the tables ``events``, ``vectors``, ``impressions``, ``personas`` and ``bindings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import without
from tidemark.sources.store import Change, Store, Table

TABLES = {
    "events": Table("event_id long, group_id string, salience double, bot_persona_name string", ("event_id",)),
    "vectors": Table("event_id long, embedding array<double>", ("event_id",)),
    "impressions": Table(
        "observer_uid string, subject_uid string, scope string, bot_persona_name string, benevolence double",
        ("observer_uid", "subject_uid", "scope", "bot_persona_name"), ("bot_persona_name",),
    ),
    "personas": Table("uid string, primary_name string, bot_persona_name string", ("uid",)),
    "bindings": Table("platform string, physical_id string, uid string", ("platform", "physical_id")),
}
_EDGE = ["observer_uid", "subject_uid", "scope"]
MODES = ("all", "impressions_only")


def open_store(spark: SparkSession, base: str) -> Store:
    return Store(spark, base, TABLES)


def upsert_vectors(store: Store, vectors: DataFrame) -> int:
    """Stores or replaces the vectors of events that exist; empty ones change nothing."""
    full = vectors.filter("event_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    known = full.join(store.read("events").select("event_id"), "event_id", "left_semi")
    return store.commit({"vectors": Change(put=known)})


def delete_events(store: Store, keys: DataFrame) -> int:
    """Events go with their vectors."""
    gone = keys.select("event_id")
    return store.commit({"events": Change(gone=gone), "vectors": Change(gone=gone)})


def upsert_personas(store: Store, personas: DataFrame, bindings: DataFrame) -> int:
    """People and all their bindings: those that a person had before and that aren't given again go."""
    before = store.read("bindings").join(personas.select("uid"), "uid", "left_semi")
    return store.commit({"personas": Change(put=personas), "bindings": Change(put=bindings, gone=without(before, bindings, ["platform", "physical_id"]))})


def _is(persona: str | None) -> Column:
    return F.col("bot_persona_name").eqNullSafe(F.lit(persona))


def _clash(rows: DataFrame, target: str | None) -> DataFrame:
    """Edges that the target has; null and the empty text are one persona there."""
    own = F.coalesce("bot_persona_name", F.lit("")) == F.lit(target or "")
    return rows.filter(own).select(*_EDGE).distinct()


def merge_personas(store: Store, source: str | None, target: str | None, mode: str = "all") -> dict[str, int]:
    """Moves what one persona owns to another, in one version; an impression of an edge that the target has goes instead.

    ``impressions_only`` leaves events and people as they are. Returns what was moved and dropped.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode: {mode}")
    version = store.version()
    impressions = store.read("impressions", version)
    own = impressions.filter(_is(source))
    moving = without(own, _clash(impressions, target), _EDGE)
    to = F.lit(target).cast("string").alias("bot_persona_name")
    total, moved = own.count(), moving.count()
    moved_rows = moving.select(*_EDGE, to, "benevolence")
    changes = {"impressions": Change(put=moved_rows, gone=own if (source or "") != (target or "") else None)}
    counts = {"events_moved": 0, "impressions_moved": moved, "impressions_dropped": total - moved, "personas_moved": 0}
    if mode == "all":
        for name, columns in (("events", ["event_id", "group_id", "salience"]), ("personas", ["uid", "primary_name"])):
            rows = store.read(name, version).filter(_is(source))
            counts[f"{name}_moved"] = rows.count()
            changes[name] = Change(put=rows.select(*columns, to))
    if (source or "") == (target or ""):  # nothing to move; an edge of its own is no clash of the same row
        return counts
    store.commit(changes, version)
    return counts


def delete_impressions(store: Store, edges: DataFrame, persona: str | None = None) -> int:
    """Impressions of edges (observer_uid, subject_uid, scope) go: of all personas (None), of none (''), or of one. Returns how many."""
    rows = store.read("impressions").join(edges.select(*_EDGE).distinct(), _EDGE, "left_semi")
    if persona is not None:
        rows = rows.filter(F.col("bot_persona_name").isNull() if persona == "" else F.col("bot_persona_name") == persona)
    n = rows.count()
    if n:
        store.commit({"impressions": Change(gone=rows)})
    return n
