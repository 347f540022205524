"""Messages on their way in, in batch and on a stream."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import embedding, text
from tidemark.streaming import ingest, traits
from tidemark.streaming import sessions as S

SCHEMA = "message_id long, ts timestamp, platform string, physical_id string, name string, group_id string, text string"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def messages():
    return [
        (1, at(0), "chat", "7", "Tom(123456)", "g", "[CQ:at,qq=1]  hi"), (2, at(5), "chat", "8", " Ann ", None, "one two"), (3, at(9), "chat", "9", None, "", None),
        (4, at(4000), "chat", "7", "Tom", "g", "late"),
    ]


def test_prepare_in_batch_and_on_a_stream(spark, tmp_path):
    bindings = spark.createDataFrame([("chat", "7", "u7"), ("mail", "8", "u8")], "platform string, physical_id string, uid string")
    df = spark.createDataFrame(messages(), SCHEMA)
    encoder = embedding.encoder(embedding.hashed)
    batch = ingest.prepare(df, bindings, encoder)
    got = {r.message_id: r for r in batch.collect()}
    assert [got[1][c] for c in ("session_id", "uid", "name", "said")] == ["chat:g", "u7", "Tom", "@用户 hi"]
    assert got[2].session_id == "chat:private:8" and got[3].said == "" and got[3].session_id == "chat:private:9"
    assert got[2].uid == spark.range(1).select(text.name_uuid(F.lit("chat:8")).alias("x")).first().x
    assert np.isclose(np.linalg.norm(got[2].embedding), 1) and not any(got[3].embedding)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.prepare(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), bindings, encoder)
    closed = S.stream_windows(stream.select("session_id", "message_id", "ts", "embedding"), S.Rules())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = closed.writeStream.format("memory").queryName("prepared").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert run.awaitTermination(120)
    assert [(r.session_id, r.messages, r.close_reason) for r in spark.table("prepared").filter("session_id = 'chat:g'").collect()] == [("chat:g", 1, "gap")]


def test_soul_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, at(i), rng.uniform(0, 5)) for i in range(60)]
    schema = "session_id string, message_id long, ts timestamp, push double"
    for k in (0, 1):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = ingest.stream_soul(stream).writeStream.format("memory").queryName("soul").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert run.awaitTermination(120)
    told = spark.table("soul").collect()
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        x = 0.0
        for r in own:
            x = 20 * math.tanh((x * 0.9 + r[3]) / 20)
        last = max((r for r in told if r.session_id == s), key=lambda r: r.turns)
        assert last.turns == len(own) and math.isclose(last.state, x)


def _run(stream, name, mode, tmp_path):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert run.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_traits_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, at(i), rng.choice([None, f"said {i}"])) for i in range(90)]
    schema = "uid string, message_id long, ts timestamp, said string"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, _run(traits.stream_traits(stream, 7), "traits", "append", tmp_path)))
    assert got == sorted(map(tuple, traits.traits(spark.createDataFrame(rows, schema), 7).collect()))
    own = [r for r in rows if r[0] == "b"]
    assert ("b", own[0][1], own[6][1], "\n".join(r[3] or "" for r in own[:7])) in got


def test_open_windows_come_out_at_the_end(spark, tmp_path):
    rows = [("a", 1, at(0)), ("a", 2, at(10)), ("b", 3, at(20)), ("a", 4, at(5000)), ("c", 5, at(5001)), ("c", 6, at(5002.5))]
    schema = "session_id string, message_id long, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.stream_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), S.Rules(gap_s=600), idle_s=100_000)
    closed = _run(stream, "open", "append", tmp_path)
    assert [(r.session_id, r.first_message, r.close_reason) for r in closed] == [("a", 1, "gap")]
    left = S.flush(spark, str(tmp_path / "ck"))
    assert left.columns == stream.columns
    assert sorted(map(tuple, left.collect())) == [("a", 4, 4, at(5000), at(5000), 1, "end"), ("b", 3, 3, at(20), at(20), 1, "end"), ("c", 5, 6, at(5001), at(5002.5), 2, "end")]
    batch = S.close_windows(spark.createDataFrame(rows, schema), S.Rules(gap_s=600)).collect()
    assert sorted((r.session_id, r.first_message, r.messages, r.close_reason) for r in batch) == sorted((r.session_id, r.first_message, r.messages, r.close_reason) for r in [*closed, *left.collect()])
