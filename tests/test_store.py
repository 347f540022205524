"""Several tables that change together."""

import os

import pytest

from tidemark.operators import memory
from tidemark.sources.store import Change, Store, Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, store, name, data):
    return spark.createDataFrame(data, store.tables[name].schema)


@pytest.fixture
def store(spark, tmp_path):
    return memory.open_store(spark, str(tmp_path / "store"))


def test_changes_are_seen_together(spark, tmp_path):
    tables = {"a": Table("k long, s string, v double", ("k", "s"), ("s",), 3), "b": Table("k long", ("k",))}
    store = Store(spark, str(tmp_path / "x"), tables)
    assert store.version() == 0 and store.read("a").count() == 0
    put = lambda *data: Change(put=spark.createDataFrame(data, "k long, s string, v double"))
    assert store.commit({"a": put((1, None, 1.0), (1, "x", 2.0), (None, "y", 3.0)), "b": Change(put=spark.createDataFrame([(1,)], "k long"))}) == 1
    # null and the empty text are one key, null is one of the number's
    assert store.commit({"a": put((1, "", 9.0), (None, "y", 4.0), (7, "z", 7.0))}) == 2
    assert rows(store.read("a")) == [(1, "", 9.0), (1, "x", 2.0), (7, "z", 7.0), (None, "y", 4.0)]
    gone = spark.createDataFrame([(1, None), (5, "none")], "k long, s string")
    assert store.commit({"a": Change(put=put((8, "n", 8.0)).put, gone=gone), "b": Change(gone=spark.createDataFrame([(1,)], "k long"))}) == 3
    assert rows(store.read("a")) == [(1, "x", 2.0), (7, "z", 7.0), (8, "n", 8.0), (None, "y", 4.0)] and store.read("b").count() == 0
    assert rows(store.read("a", 1)) == [(1, "x", 2.0), (1, None, 1.0), (None, "y", 3.0)] and store.read("b", 2).count() == 1
    # a change that was written but not published is not seen, and goes with the next vacuum
    store._write("a", put((99, "q", 0.0)))
    assert 99 not in {r.k for r in store.read("a").collect()}
    before = rows(store.read("a"))
    assert store.compact("a") == 4 and len(store.manifest()["a"]) == 1 and rows(store.read("a")) == before
    assert len(store.vacuum()) == 4 and rows(store.read("a")) == before and store.version() == 4
    # of two writers on one version, one is told
    assert store.commit({"b": Change(put=spark.createDataFrame([(3,)], "k long"))}, onto=4) == 5
    with pytest.raises(RuntimeError):
        store.commit({"b": Change(put=spark.createDataFrame([(4,)], "k long"))}, onto=4)
    assert rows(store.read("b")) == [(3,)]
    assert not [n for n in os.listdir(tmp_path / "x/manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_a_few_keys_read_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"), {"a": Table("k long, v long", ("k",), (), 8)})
    store.commit({"a": Change(put=spark.range(1000).selectExpr("id AS k", "id AS v"))})
    store.commit({"a": Change(put=spark.createDataFrame([(5, -5)], "k long, v long"))})
    got = store.read("a", only=spark.createDataFrame([(5,), (2000,)], "k long"))
    assert rows(got) == [(5, -5)]
    assert "_bucket" in got._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_vectors_of_events(spark, store):
    store.commit({"events": Change(put=frame(spark, store, "events", [(1, "g", 0.5, None), (2, None, 0.5, "a")]))})
    memory.upsert_vectors(store, frame(spark, store, "vectors", [(1, [1.0]), (2, [2.0]), (3, [3.0]), (None, [4.0])]))
    memory.upsert_vectors(store, frame(spark, store, "vectors", [(1, [9.0]), (2, []), (2, None)]))
    assert rows(store.read("vectors")) == [(1, [9.0]), (2, [2.0])]
    version = memory.delete_events(store, frame(spark, store, "events", [(1, None, None, None)]))
    assert rows(store.read("vectors")) == [(2, [2.0])] and [r.event_id for r in store.read("events").collect()] == [2]
    assert store.read("vectors", version - 1).count() == 2


def test_people_and_bindings(spark, store):
    people = frame(spark, store, "personas", [("u1", "Ann", None), ("u2", "Bo", None)])
    memory.upsert_personas(store, people, frame(spark, store, "bindings", [("chat", "1", "u1"), ("mail", "a", "u1"), ("chat", "2", "u2")]))
    memory.upsert_personas(store, frame(spark, store, "personas", [("u1", "Anna", "p")]), frame(spark, store, "bindings", [("chat", "1", "u1"), ("web", "w", "u1")]))
    assert rows(store.read("personas")) == [("u1", "Anna", "p"), ("u2", "Bo", None)]
    assert rows(store.read("bindings")) == [("chat", "1", "u1"), ("chat", "2", "u2"), ("web", "w", "u1")]


def filled(spark, store):
    edge = lambda o, s, scope, p, b: (o, s, scope, p, b)
    store.commit({
        "events": Change(put=frame(spark, store, "events", [(1, "g", 0.1, "Alice"), (2, "g", 0.2, "Alice"), (3, None, 0.3, "Other"), (4, None, 0.4, None)])),
        "personas": Change(put=frame(spark, store, "personas", [("p1", "x", "Alice"), ("p2", "y", "Bob"), ("p3", "z", None)])),
        "impressions": Change(put=frame(spark, store, "impressions", [
            edge("u1", "u2", "global", "Bob", 0.9), edge("u1", "u2", "global", "Alice", 0.2), edge("u1", "u2", "g-only", "Alice", 0.4), edge("u1", "u3", "global", None, 0.6),
        ])),
    })


def test_a_merge_moves_all_tables_and_the_target_wins(spark, store):
    filled(spark, store)
    before = store.version()
    counts = memory.merge_personas(store, "Alice", "Bob")
    assert counts == {"events_moved": 2, "impressions_moved": 1, "impressions_dropped": 1, "personas_moved": 1}
    assert store.version() == before + 1
    assert rows(store.read("impressions")) == [("u1", "u2", "g-only", "Bob", 0.4), ("u1", "u2", "global", "Bob", 0.9), ("u1", "u3", "global", None, 0.6)]
    assert {r.event_id: r.bot_persona_name for r in store.read("events").collect()} == {1: "Bob", 2: "Bob", 3: "Other", 4: None}
    assert {r.uid: r.bot_persona_name for r in store.read("personas").collect()} == {"p1": "Bob", "p2": "Bob", "p3": None}
    assert store.read("impressions", before).count() == 4
    assert memory.merge_personas(store, "Bob", None)["impressions_moved"] == 2
    assert {r.bot_persona_name for r in store.read("impressions").collect()} == {None}
    assert memory.merge_personas(store, None, "New")["impressions_moved"] == 3
    assert memory.merge_personas(store, "Nobody", "New") == dict.fromkeys(counts, 0)


def test_a_merge_of_impressions_only(spark, store):
    filled(spark, store)
    counts = memory.merge_personas(store, "Alice", "Carol", "impressions_only")
    assert counts == {"events_moved": 0, "impressions_moved": 2, "impressions_dropped": 0, "personas_moved": 0}
    assert {r.bot_persona_name for r in store.read("events").collect()} == {"Alice", "Other", None}
    assert {r.bot_persona_name for r in store.read("impressions").collect()} == {"Bob", "Carol", None}
    with pytest.raises(ValueError):
        memory.merge_personas(store, "a", "b", "some")


def test_impressions_are_deleted_for_all_none_or_one(spark, store):
    filled(spark, store)
    edges = lambda *keys: spark.createDataFrame(keys, "observer_uid string, subject_uid string, scope string")
    assert memory.delete_impressions(store, edges(("u1", "u2", "global")), "") == 0
    assert memory.delete_impressions(store, edges(("u1", "u2", "global")), "Alice") == 1
    assert memory.delete_impressions(store, edges(("u1", "u3", "global")), "") == 1
    assert memory.delete_impressions(store, edges(("u1", "u2", "global"), ("u1", "u2", "g-only"))) == 2
    assert store.read("impressions").count() == 0 and memory.delete_impressions(store, edges(("u1", "u2", "global"))) == 0
