"""Operators on small fixtures: rules that the queries' SQL doesn't reach."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import circumplex, text
from tidemark.operators import clusters, lifecycle, retrieval, scope, social, windows
from tidemark.streaming import sessions as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# circumplex


def test_octants_turn_by_45_degrees(spark):
    got = [one(spark, circumplex.octant(F.lit(math.cos(math.radians(a))), F.lit(math.sin(math.radians(a))))) for a in range(0, 360, 45)]
    assert tuple(got) == circumplex.OCTANTS
    assert one(spark, circumplex.octant(F.lit(0.0), F.lit(0.0))) == "affinity"
    assert one(spark, circumplex.fit(F.lit(1.0), F.lit(0.0))) == 1.0 and one(spark, circumplex.fit(F.lit(0.0), F.lit(0.0))) == 0.5
    assert one(spark, circumplex.intensity(F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)


def test_labels_become_english(spark):
    assert one(spark, circumplex.normalize_label(F.lit("支配"))) == "dominant"
    assert one(spark, circumplex.normalize_label(F.lit("cold"))) == "cold"
    assert one(spark, circumplex.normalize_label(F.lit("?"))) == "affinity"


# text


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("[CQ:at,qq=1] hi", "@用户 hi"), ("[CQ:image,file=x]", "[图片]"), ("[CQ:mface,id=2]ok", "[表情]ok"), ("a [CQ:other,x=1] b", "a b"),
        ("Tom(12345) said  hi", "Tom said hi"), ("Tom(1234)", "Tom(1234)"), ("  ", ""), (None, ""), ("[CQ:json,data={}]", "[卡片]"),
    ],
)
def test_normalize(raw, clean, spark):
    assert one(spark, text.normalize_message(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("said", "noisy"), [("hi", True), ("aaaaaaab", True), ("aaab", False), ("hello there", False), ("😀😀😀😀", True), (None, True)])
def test_noise(said, noisy, spark):
    assert one(spark, text.is_noise(F.lit(said).cast("string"))) is noisy


def test_parse_extraction(spark):
    raw = (
        'Here:\n```json\n[{"start_idx":0,"end_idx":2,"topic":"T","summary":"S","chat_content_tags":["a","b"],"salience":1.7,"confidence":0.4},'
        '{"start_idx":3,"end_idx":99,"topic":"x","summary":"y","chat_content_tags":[],"salience":0.5,"confidence":0.5}]\n```'
    )
    got = one(spark, text.parse_extraction(F.lit(raw), F.lit(5)))
    assert [(r.topic, r.tags, r.salience, r.confidence, r.inherit) for r in got] == [("T", ["a", "b"], 1.0, 0.4, False)]


def test_parse_traits(spark):
    raw = '{"ann":{"scores":{"O":2,"C":-0.5},"evidence":"said so"},"bob":{"E":0.25,"X":1},"eve":{"X":1}}'
    got = one(spark, text.parse_traits(F.lit(raw)))
    assert {k: (v.scores, v.evidence) for k, v in got.items()} == {"ann": ({"O": 1.0, "C": -0.5}, "said so"), "bob": ({"E": 0.25}, None)}


def test_small_text_functions(spark):
    assert one(spark, text.truncate(F.lit("a  b   c"), 4)) == "a b…"
    assert one(spark, text.strip_thoughts(F.lit("<think>x\ny</think> z"))) == "z"
    assert [one(spark, text.age_label(F.lit(float(s)))) for s in (5, 3599, 7200, 200_000)] == ["1分钟前", "59分钟前", "2小时前", "2天前"]
    assert one(spark, text.percent_of_trait(F.lit(0.5))) == 75
    assert [r.what for r in one(spark, text.parse_topics(F.lit("[What] a [Who] b | [What] c")))] == ["a", "c"]
    assert one(spark, text.section(F.lit("## One\nx\n## Two\ny"), "Two")) == "y"
    assert one(spark, text.affect_label(F.lit(-0.7))) == "negative (-0.70)"


# retrieval


def test_thread_order(spark):
    """A -> B -> C, D alone; B is best: B, A, C, D."""
    memories = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "event_id long, parent long")
    anchors = spark.createDataFrame([(2, "episode", 0.9), (4, "episode", 0.1)], "event_id long, event_type string, score double")
    got = retrieval.expand_threads(anchors, memories).orderBy("place").collect()
    assert [r.event_id for r in got] == [2, 1, 3, 4]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    one_way, other = ({r.id: r.rrf for r in retrieval.rrf(lists, "id").collect()} for lists in ([a, b], [b, a]))
    assert one_way == pytest.approx(other) and max(one_way, key=one_way.get) == "y"


def test_budget_is_a_greedy_prefix(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.random(), rng.randint(1, 90)) for g in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id int, salience double, c int")
    got = {(r.g, r.id) for r in retrieval.fill_budget(df, F.col("c"), 300, 8, ["g"], "id").collect()}
    want = set()
    for g in "ab":
        used = 8
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if used + r[3] > 300:
                break
            used += r[3]
            want.add((g, r[1]))
    assert got == want


def test_cold_sampling_takes_the_best(spark):
    df = spark.createDataFrame([(i, i / 100) for i in range(100)], "id int, s double")
    cold = {r.id for r in retrieval.sample_softmax(df, "s", "id", 5, 1e-5, 1).collect()}
    assert cold == {95, 96, 97, 98, 99}
    hot = [tuple(r.id for r in retrieval.sample_softmax(df, "s", "id", 5, 10.0, seed).collect()) for seed in (1, 1, 2)]
    assert hot[0] == hot[1] != hot[2]


def test_knn_order(spark):
    df = spark.createDataFrame([("e1", [1.0, 0.0, 0.0, 0.0]), ("e2", [0.0, 1.0, 0.0, 0.0]), ("e0", [0.0] * 4)], "id string, embedding array<float>")
    got = retrieval.knn(df, "id", [0.99, 0.01, 0, 0], 3).collect()
    assert [r.id for r in got] == ["e1", "e2", "e0"] and got[2].similarity == 0.0


# windows and sessions


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_gap_is_strict(spark):
    df = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(30)), ("s", 3, at(60.5))], "k string, id int, ts timestamp_ntz")
    assert [r.session for r in windows.sessions(df, "k", "ts", "id").orderBy("id").collect()] == [1, 1, 2]


def test_prune_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(1, 40), rng.random() < 0.2) for g in "abc" for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id int, n int, locked boolean")
    got = {(r.g, r.id) for r in windows.prune(df, "g", ["id"], "n", "locked", 300, 50).collect()}
    want = set()
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        left = total = sum(r[2] for r in own if not r[3])
        for r in own:
            if not r[3] and total > 300 and left > 250:
                left -= r[2]
            else:
                want.add((g, r[1]))
    assert got == want


def replay(messages, rules):
    w, out = S.Window(), []
    for m, t, v in messages:
        w, closed = S.step(w, m, t, v, rules)
        out += [closed] if closed else []
    return [*out, S.told(w, "end")]


def test_close_rules():
    rules = S.Rules(max_messages=1, rounds=30)
    assert [c[-1] for c in replay([(1, 0, None), (2, 1800, None), (3, 3601, None)], rules)] == ["gap", "end"]
    assert [c[4:] for c in replay([(i, i, None) for i in range(120)], rules)] == [(50, "count"), (50, "count"), (20, "end")]
    assert [c[-1] for c in replay([(1, 0, None), (2, 1800, None), (3, 3600, None)], rules)] == ["duration", "end"]


def test_drift_takes_effect_on_the_next_message():
    same, other = [1.0, 0.0], [0.0, 1.0]
    told = replay([(i, i, same) for i in range(19)] + [(19, 19, other), (20, 20, same), (21, 21, same)], S.Rules())
    assert [(c[4], c[5]) for c in told] == [(20, "drift"), (2, "end")]


@pytest.mark.parametrize("part", [S.PART, 20])
def test_batch_windows_equal_the_loop(part, spark, monkeypatch):
    monkeypatch.setattr(S, "PART", part)
    rng = random.Random(6)
    rules, rows = S.Rules(gap_s=600, max_messages=5, rounds=8), []
    for s in ("a", "b"):
        t = 0.0
        for i in range(150):
            t += rng.choice([5, 30, 200, 700])
            rows.append((s, i, at(t / 60)))
    got = S.close_windows(spark.createDataFrame(rows, "session_id string, message_id long, ts timestamp_ntz"), rules).collect()
    for s in ("a", "b"):
        want = replay([(i, S._seconds(t), None) for k, i, t in rows if k == s], rules)
        assert sorted((r.first_message, r.last_message, r.messages, r.close_reason) for r in got if r.session_id == s) == sorted((c[0], c[1], c[4], c[5]) for c in want)


def test_stream_equals_batch(spark, tmp_path):
    rng, rows, t = random.Random(7), [], 0.0
    for i in range(200):
        t += rng.choice([5, 30, 200, 700])
        rows.append((rng.choice("ab"), i, at(t / 60)))
    rows.append(("z", 999, at(t / 60 + 100_000)))  # moves the watermark on
    schema = "session_id string, message_id long, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = S.Rules(gap_s=600, max_messages=5, rounds=8)
    stream = S.stream_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, idle_s=3600)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = stream.writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert run.awaitTermination(120)
    got = sorted((r.session_id, r.first_message, r.messages) for r in spark.table("told").collect())
    batch = S.close_windows(spark.createDataFrame([r for r in rows if r[0] != "z"], schema), rules).collect()
    assert got == sorted((r.session_id, r.first_message, r.messages) for r in batch)


# graph and clusters


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (103, 102), (102, 101), (50, 51)]
    got = {r.node: r.component for r in clusters.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 102: 100, 103: 100, 50: 50, 51: 50}


def test_dbscan(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.0, [1.0, 0.0]), (1, 2, 1.0, [1.0, 0.01]), (1, 3, 2.0, [0.0, 1.0]), (2, 4, 0.0, [1.0, 1.0])],
        "session_id long, message_id long, ts double, embedding array<float>",
    )
    assert {r.message_id: r.cluster for r in clusters.dbscan(df, 0.1).collect()} == {1: 0, 2: 0, 3: -1, 4: -1}
    points = np.random.default_rng(0).normal(size=(60, 4))
    found = clusters._cluster(points, np.zeros(60), 0.2, 2)
    near = 1 - (u := points / np.linalg.norm(points, axis=1, keepdims=True)) @ u.T <= 0.2
    for i in range(60):
        for j in range(60):
            if near[i, j] and i != j:
                assert found[i] == found[j] >= 0


def test_mutual_edges(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 3), (2, 1, 0.25, 1), (3, 1, 0.4, 2)], "observer long, subject long, intensity double, n long")
    got = {(r.u, r.v): (r.mutual, round(r.affinity, 6), r.messages) for r in social.mutual(df).collect()}
    assert got == {(1, 2): (True, 0.9, 4), (1, 3): (False, 0.4, 2)}


# life cycle and scopes


def test_cleanup_expires_before_it_archives(spark):
    schema = "event_id int, salience double, status string, is_locked boolean, start_time double"
    df = spark.createDataFrame([(1, 0.8, "active", False, 0.0), (2, 0.1, "active", False, 0.0), (3, 0.1, "active", True, 0.0), (4, 0.9, "archived", False, 0.0)], schema)
    assert {r.event_id: r.status for r in lifecycle.cleanup(df, 10.0, 0.3).collect()} == {1: "active", 2: "archived", 3: "active"}


def test_merge_keeps_the_target(spark):
    rows = [("u1", "u2", "Bob", 0.9), ("u1", "u2", "Alice", 0.2), ("u1", "u3", "Alice", 0.4), ("u1", "u2", None, 0.1)]
    df = spark.createDataFrame(rows, "o string, s string, p string, b double")
    got = {(r.o, r.s, r.p, r.b) for r in lifecycle.merge_persona(df, "p", "Alice", "Bob", ["o", "s"]).collect()}
    assert got == {("u1", "u2", "Bob", 0.9), ("u1", "u3", "Bob", 0.4), ("u1", "u2", None, 0.1)}
    assert tuple(lifecycle.merge_preview(df, "p", "Alice", "Bob", ["o", "s"]).first()) == (1, 1)


def test_upserts_repeat(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, created string, v double")
    new = spark.createDataFrame([(2, "z", 9.0), (3, "c", 3.0)], "k int, created string, v double")
    once = lifecycle.upsert_keep(old, new, ["k"], ["created"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)}
    assert {tuple(r) for r in lifecycle.upsert_keep(once, new, ["k"], ["created"]).collect()} == {tuple(r) for r in once.collect()}
    assert {r.k for r in lifecycle.insert_ignore(old, new, ["k"]).collect()} == {1, 2, 3}


def test_persona_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    seen = lambda *args: {r.p for r in df.filter(scope.persona(F.col("p"), *args)).collect()}
    assert seen(None) == {"a", "b", None} and seen("") == {None} and seen("a") == {"a", None} and seen("a", False) == {"a"}
    assert {r.p for r in df.filter(scope.in_group(F.col("p"), None)).collect()} == {None}


def test_null_keys_are_keys(spark):
    """Rows from before there were personas have a null one; it is replaced, merged from and merged into like any other."""
    schema = "o string, s string, p string, b double"
    old = spark.createDataFrame([("a", "b", None, 0.1), ("a", "b", "Bob", 0.2), ("c", "d", None, 0.3)], schema)
    new = spark.createDataFrame([("a", "b", None, 0.9)], schema)
    rows = lambda df: sorted(tuple(r) for r in df.fillna("-").collect())
    assert rows(lifecycle.upsert(old, new, ["o", "s", "p"])) == [("a", "b", "-", 0.9), ("a", "b", "Bob", 0.2), ("c", "d", "-", 0.3)]
    assert rows(lifecycle.upsert_keep(old, new, ["o", "s", "p"], ["b"])) == rows(old)
    assert rows(lifecycle.insert_ignore(old, new, ["o", "s", "p"])) == rows(old)
    assert rows(lifecycle.merge_persona(old, "p", None, "Bob", ["o", "s"])) == [("a", "b", "Bob", 0.2), ("c", "d", "Bob", 0.3)]
    assert rows(lifecycle.merge_persona(old, "p", "Bob", None, ["o", "s"])) == [("a", "b", "-", 0.1), ("c", "d", "-", 0.3)]
    assert tuple(lifecycle.merge_preview(old, "p", None, "Bob", ["o", "s"]).first()) == (1, 1)
    assert tuple(lifecycle.merge_preview(old, "p", "Nobody", "Bob", ["o", "s"]).first()) == (0, 0)
    empty = spark.createDataFrame([("a", "b", "", 0.7)], schema)
    assert rows(lifecycle.upsert(old, empty, ["o", "s", "p"], ("p",))) == [("a", "b", "", 0.7), ("a", "b", "Bob", 0.2), ("c", "d", "-", 0.3)]
    assert rows(lifecycle.merge_persona(old.unionByName(empty), "p", "Bob", None, ["o", "s"])) == [("a", "b", "", 0.7), ("a", "b", "-", 0.1), ("c", "d", "-", 0.3)]
    assert tuple(lifecycle.merge_preview(empty.unionByName(old.filter("p = 'Bob'")), "p", "Bob", None, ["o", "s"]).first()) == (0, 1)
    out = social.smooth(old, new, ["o", "s", "p"], ["b"], 0.5)
    assert rows(out) == [("a", "b", "-", 0.5), ("a", "b", "Bob", 0.2), ("c", "d", "-", 0.3)]


def test_all_labels(spark):
    for spelling, name in {**circumplex.SPELLINGS, **{x: x for x in circumplex.OCTANTS}}.items():
        assert one(spark, circumplex.normalize_label(F.lit(spelling))) == name
    assert len(circumplex.SPELLINGS) + len(circumplex.OCTANTS) == 33
    assert one(spark, circumplex.normalize_label(F.lit("odd"), "as it is")) == "as it is"


def test_white_space_of_any_kind_goes(spark):
    assert one(spark, text.strip_thoughts(F.lit("<think>x</think>\n　 a\nb\t\n"))) == "a\nb"
    assert one(spark, text.is_noise(F.lit("\n\n\n\n"))) and one(spark, text.normalize_name(F.lit("\n Tom(123456)\t"))) == "Tom"
    assert one(spark, text.section(F.lit("## One\n\n x\n\n## Two\ny\n"), "One")) == "x"
    assert not one(spark, text.is_tag(F.lit("\n\t"))) and one(spark, text.tokens(F.lit("abcde"))) == 2 and one(spark, text.tokens(F.lit(""))) == 1


def test_rolling_equals_one_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 20), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, t int, v double")
    got = windows.rolling(windows.numbered(df, "k", ["t", "id"], F.col("t")), "k", "position", 7, 20, m=F.sum("v"))
    seen = {r.id: (r.position, r.m) for r in got.collect()}
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        for n, r in enumerate(own):
            assert seen[r[1]][0] == n + 1 and seen[r[1]][1] == pytest.approx(sum(x[3] for x in own[max(0, n - 6) : n + 1]))
    assert len(seen) == 400


def test_knn_of_many_questions(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(50, 4)).round(1)
    points[7] = 0
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(99, None)], "id long, embedding array<double>").repartition(4)
    asked = df.filter("id % 5 = 0 or id = 7").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.id for r in retrieval.knn_batch(df, "id", asked, 3, block=4).collect()}
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    for q in [*range(0, 50, 5), 7]:
        s = (unit @ unit[q]).round(12)
        assert [got[q, n] for n in (1, 2, 3)] == sorted(range(50), key=lambda i: (-s[i], i))[:3]
    assert retrieval.knn_batch(df, "id", asked.limit(0), 3).count() == 0 == retrieval.knn_batch(df.limit(0), "id", asked, 3).count()


def test_written_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red red blue"), (2, "blue"), (3, None), (4, "")], "id long, t string")
    retrieval.write_postings(docs, "id", "t", str(tmp_path / "x"), buckets=4)
    found = retrieval.search_postings(spark, str(tmp_path / "x"), "id", ["RED", "blue", "none"])
    want = {r.id: r.score for r in retrieval.bm25(docs, "id", "t", ["red", "blue"]).collect()}
    assert {r.id: pytest.approx(r.score) for r in found.collect()} == want and {r.id: r.matched for r in found.collect()} == {1: 2, 2: 1}
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_postings_are_counted_where_rows_stand(spark, tmp_path, monkeypatch):
    """Words don't travel: no exchange below the postings; the written ones are those of the rows, sorted; rows of one key and length are one document."""
    monkeypatch.setattr(retrieval, "LIST_WORDS", 50)
    rows = [(f"k{i}", " ".join(f"w{i * j % 17}" for j in range(i % 30))) for i in range(90)] + [("d", "w1 w2 w1"), ("d", "w1 w3 w4"), ("n", None), ("n", ""), (None, "w1")]
    docs = spark.createDataFrame(rows, "id string, t string").repartition(3)
    want = Counter((w, k, len(t.split()), t.split().count(w)) for k, t in rows if t for w in set(t.split()))
    held = retrieval.postings(docs, "id", "t")
    assert held.columns == ["term", "id", "len", "tf"] and Counter(map(tuple, held.collect())) == want
    assert retrieval.postings(spark.createDataFrame(rows, "id string, t string"), "id", "t")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    path = str(tmp_path / "x")
    retrieval.write_postings(docs, "id", "t", path, buckets=2)
    assert Counter((r.term, r.id, r.len, r.tf) for r in spark.read.parquet(f"{path}/postings").collect()) == want
    both = {r.id: r.matched for r in retrieval.search_postings(spark, path, "id", ["w1", "w2"]).collect()}
    assert both["d"] == 2 and both[None] == 1
    merged = spark.createDataFrame([("d", "a a b"), ("d", "a c e"), ("x", "b b b"), ("y", "c"), ("z", "q"), ("v", "q")], "id string, t string")
    retrieval.write_postings(merged, "id", "t", f"{path}2")
    found = {r.id: r.score for r in retrieval.search_postings(spark, f"{path}2", "id", ["a"]).collect()}
    average = (3 + 3 + 3 + 1 + 1 + 1) / 6
    assert found == {"d": pytest.approx(math.log(5.5 / 1.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 3 / average)))}


def test_moods_of_any_shape(spark):
    people = F.array(F.struct(F.lit("u1").alias("uid"), F.lit("Ann").alias("name")), F.struct(F.lit("u2").alias("uid"), F.lit(None).cast("string").alias("name")))
    told = lambda answer: one(spark, text.mood_text(F.lit(answer), people))
    head = "群体情感动态整体偏向[%s] | [平均亲和度：%s；平均支配度：%s] | "
    at = lambda names, label: f"[{names}处于群体中的{label}位置]"
    assert told('x ```json\n{"orientation": "主动", "benevolence": 0.5, "positions": {"u1": "亲和", "u9": {"position": "冷淡"}}}\n``` y') == head % ("主动", "+0.50", "+0.00") + " | ".join([at("Ann", "亲和"), at("u9", "冷淡"), at("u2", "未知")])
    assert told('{"power": -1, "positions": {"u1": {"orientation": "未知"}, "u2": 3}}') == head % ("亲和", "+0.00", "-1.00") + " | ".join([at("Ann", "未知"), at("u2", "3")])
    assert told('{"benevolence": "0.25", "positions": [1, 2]}') == head % ("亲和", "+0.25", "+0.00") + at("Ann, u2", "未知")
    assert told("{}") == head % ("亲和", "+0.00", "+0.00") + at("Ann, u2", "未知")
    assert told('{"positions": {"u1": null, "u2": {}}}') == head % ("亲和", "+0.00", "+0.00") + " | ".join([at("Ann", "None"), at("u2", "未知")])
    assert told('{"broken": [') is None and told("none") is None and told(None) is None and told("") is None
