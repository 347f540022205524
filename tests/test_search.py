"""Search over sets of questions, aligned tags, written indexes, scans without a task per key, pairs of large events."""

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import indexes, questions, retrieval, social, tags, windows
from tidemark.sources import tables


def documents(rng, n, common=40, rare=400):
    """Texts of common and rare words, as most texts are."""
    rows = []
    for i in range(n):
        words = [f"c{int(common * rng.random() ** 3)}" for _ in range(rng.integers(5, 60))] + [f"r{rng.integers(rare)}" for _ in range(rng.integers(0, 6))]
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (None, "c1 r1")]


def exhaustive(spark, docs, asked, k):
    """BM25 sums by joining all postings."""
    held = retrieval.postings(docs.filter("id IS NOT NULL"), "id", "t")
    n, average = docs.filter("id IS NOT NULL").agg(F.count(F.lit(1)), F.avg(F.size(retrieval.word_list(F.col("t"))))).first()
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    met = asked.select("query_id", F.lower("term").alias("term")).distinct().join(df, "term").join(held, "term")
    scored = met.groupBy("query_id", "id").agg(F.sum(retrieval._weight(idf, average)).alias("score")).collect()
    out = {}
    for q in {r.query_id for r in scored if r.query_id is not None}:
        own = sorted(((-round(r.score, 6), r.id) for r in scored if r.query_id == q))[:k]
        out[q] = [i for _, i in own]
    return out


@pytest.mark.parametrize("block", [30, questions.ASKED])
def test_questions_equal_the_exhaustive_sum(spark, block):
    rng = np.random.default_rng(4)
    rows = documents(rng, 1500)
    docs = spark.createDataFrame(rows, "id long, t string").repartition(3)
    asked = spark.createDataFrame([(i, w) for i, t in rows[:1500:150] for w in set(t.upper().split())] + [(7777, "nowhere"), (None, "c1")], "query_id long, term string")
    got = {}
    for r in questions.bm25_batch(docs, "id", "t", asked, 5, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == exhaustive(spark, docs, asked, 5)
    assert questions.bm25_batch(docs.limit(0), "id", "t", asked, 5).count() == 0 == questions.bm25_batch(docs, "id", "t", asked.limit(0), 5).count()


def test_common_terms_are_passed_over():
    """Of ten times the documents, the search touches a shrinking share of the pairs of a question's term and a document."""
    rng = np.random.default_rng(2)
    n_terms, n_questions, share = 300, 4, []
    chance = np.where(np.arange(n_terms) < 100, 0.45, 0.03)
    asked = [np.unique(rng.choice(n_terms, 60)) for _ in range(n_questions)]
    question, term = np.repeat(np.arange(n_questions), [len(a) for a in asked]), np.concatenate(asked)
    order = np.lexsort((question, term))
    question, term = question[order], term[order]
    for n in (1000, 10_000):
        held = rng.random((n, n_terms)) < chance
        for a in asked:  # some documents are much like a question
            held[rng.choice(n, 40)] |= np.isin(np.arange(n_terms), a)
        df = held.sum(axis=0)
        idf = np.maximum(1e-6, np.log((n - df + 0.5) / (df + 0.5)))
        length = held.sum(axis=1)
        search = questions.Search(question, term, idf, idf * 2.2, n_questions, 5, length.mean())
        for a in range(0, n, questions.ROWS):
            part = held[a : a + questions.ROWS]
            row, at = np.nonzero(part)
            search.show(np.arange(a, a + len(part)), row, at, np.ones(len(row)), length[a : a + questions.ROWS])
        share.append(search.met / sum(int(df[a].sum()) for a in asked))
        weight = held * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / length.mean()))[:, None]
        for j, a in enumerate(asked):
            s = weight[:, a].sum(axis=1)
            assert search.best[j][1].tolist() == sorted(range(n), key=lambda i: (-round(s[i], 6), i))[:5]
    assert share[1] < share[0] and share[1] < 0.9, share


def test_many_questions_are_a_product(spark):
    """Common terms of many questions are multiplied, not met one by one, with the results of the exhaustive sum."""
    rng = np.random.default_rng(8)
    rows = documents(rng, 1200)
    docs = spark.createDataFrame(rows + [(i + 5000, t) for i, t in rows[:1200:40]], "id long, t string").repartition(2)
    asked = spark.createDataFrame([(i, w) for i, t in rows[:1200:10] for w in set(t.split())], "query_id long, term string")
    got = {}
    for r in questions.bm25_batch(docs, "id", "t", asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == exhaustive(spark, docs, asked, 5) and len(got) == 120
    held = rng.random((3000, 200)) < np.where(np.arange(200) < 120, 0.4, 0.02)
    question, term = np.nonzero(held[:100])
    order = np.lexsort((question, term))
    idf, length = np.log(3000 / (held.sum(axis=0) + 1.0)), held.sum(axis=1)
    search = questions.Search(question[order], term[order], idf, idf * 2.2, 100, 5, length.mean(), held.mean(axis=0))
    for a in range(0, 3000, questions.ROWS):
        row, at = np.nonzero(held[a : a + questions.ROWS])
        search.show(np.arange(a, min(3000, a + questions.ROWS)), row, at, np.ones(len(row)), length[a : a + questions.ROWS])
    assert search.met < 0.1 * held[:100].sum(axis=0) @ held.sum(axis=0)
    weight = held * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / length.mean()))[:, None]
    for j, s in enumerate((weight @ held[:100].T).T):
        assert search.best[j][1].tolist() == sorted(range(3000), key=lambda i: (-round(s[i], 6), i))[:5]


# tags


def in_order(rows, threshold):
    canonical, out = [], {}
    for i, v in sorted(rows):
        best = max(((float(v @ u), -j) for j, u in canonical), default=(-1, 0))
        if best[0] >= threshold:
            out[i] = (-best[1], False)
        else:
            canonical.append((i, v))
            out[i] = (i, True)
    return out


@pytest.mark.parametrize("front", [1, 7, 4096])
def test_tags_are_registered_in_order(spark, front):
    rng = np.random.default_rng(front)
    centres = rng.normal(size=(6, 8))
    points = [(i, tags._unit((centres[i % 6] + rng.normal(size=8) * 0.5)[None])[0]) for i in rng.permutation(60).tolist()]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points] + [(3, dict(points)[3].tolist()), (99, None)], "id long, embedding array<double>").repartition(3)
    for part in (df, df.repartition(7)):
        got = {r.id: (r.tag, r.registered) for r in tags.register(part, "id", 0.8, front).collect()}
        assert got == in_order(points, 0.8)
    assert 6 <= sum(x for _, x in got.values()) < 60
    assert tags.register(df.limit(0), "id", 0.8).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_canonical(spark, block):
    rng = np.random.default_rng(1)
    units = tags._unit(rng.normal(size=(50, 5)))
    units[9] = units[4]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)] + [(70, None)], "id long, embedding array<double>")
    got = {r.id: (r.tag, round(r.similarity, 9)) for r in tags.nearest(df, df.filter("id < 30"), "id", block=block).collect()}
    s = (units @ units[:30].T).round(9)
    assert got == {i: (min(range(30), key=lambda j: (-s[i][j], j)), s[i].max()) for i in range(50)}
    earlier = {r.id: r.tag for r in tags.nearest(df, df, "id", earlier=True, block=block).collect()}
    full = (units @ units.T).round(9)
    assert earlier == {i: min(range(i), key=lambda j: (-full[i][j], j), default=None) for i in range(50)}
    assert {r.tag for r in tags.nearest(df, df.limit(0), "id").collect()} == {None}


# indexes


def test_cells_are_exact_and_prune(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 6)) * 4
    points = [(i, (centres[i % 20] + rng.normal(size=6)).tolist()) for i in range(2000)] + [(5000, [0.0] * 6), (5001, None)]
    df = spark.createDataFrame(points, "id long, embedding array<double>").repartition(4)
    path = str(tmp_path / "x")
    indexes.write_cells(df, "id", indexes.fit_cells(df, "id", 20), path)
    assert spark.read.parquet(f"{path}/vectors").count() == 2001
    asked = df.filter("id % 100 = 0 AND id < 5000").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r["rank"]): r.id for r in retrieval.knn_batch(df, "id", asked, 10).collect()}
    assert {(r.query_id, r["rank"]): r.id for r in indexes.search_cells(spark, path, "id", asked, 10).collect()} == exact
    some = indexes.search_cells(spark, path, "id", asked, 10, probes=3)
    found = {(r.query_id, r.id) for r in some.collect()}
    assert len(found & {(q, i) for (q, _), i in exact.items()}) >= 0.9 * len(exact)
    one = indexes.search_cells(spark, path, "id", asked.limit(1), 10, probes=1)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() and one.count() == 10
    assert indexes.search_cells(spark, path, "id", asked.limit(0), 10).count() == 0


def test_a_large_cell_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "FILE", 50)
    df = spark.range(600).selectExpr("id", "array(1.0D, id / 1e6D) AS embedding")
    indexes.write_cells(df, "id", np.array([[1.0, 0.0], [0.0, 1.0]]), str(tmp_path / "x"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "x/vectors")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 600 and len(sizes) > 2 and max(sizes) < 400


def test_needles_together_find_what_each_does(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab aba"[i % 4 :] + " needle ÉÉÉ" * (i % 3), ["Red tag", None][i % 2 :]) for i in range(60)] + [(None, "ab", None), (9000, None, None)], "id long, t string, tags array<string>")
    fields, path = {"t": F.col("t"), "tags": F.col("tags")}, str(tmp_path / "x")
    indexes.write_trigrams(df, "id", fields, path, per_bucket=500)
    df = df.filter("id IS NOT NULL")
    needles = ["ab", "BAB", "red t", "needle", "none of these", "ééé", "a"]
    want = sorted((n, r.id) for n in needles for r in indexes.search_trigrams(df, "id", fields, path, n).collect())
    assert sorted((r.needle, r.id) for r in indexes.search_needles(df, "id", fields, path, needles).collect()) == want
    once = indexes.search_needles(df, "id", fields, path, needles[1:3])
    assert sorted(tuple(r) for r in once.collect()) == [(n, i) for n, i in want if n in needles[1:3]]


def test_trigrams(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 40))), [rng.choice(["Red tag", "blue", "", None]) for _ in range(rng.randint(0, 3))]) for i in range(300)]
    rows += [(300, None, None), (9000, "x" * 30_000 + "needle", []), (9001, "😀😀a😀", ["ÉÉÉ"])]
    df = spark.createDataFrame(rows, "id long, t string, tags array<string>")
    fields, path = {"t": F.col("t"), "tags": F.col("tags")}, str(tmp_path / "x")
    assert indexes.write_trigrams(df, "id", fields, path, per_bucket=500) > 1
    for needle in ("ab", "aba", "BAB", "red t", "needle", "none of these", "xxxn", "😀a😀", "ééé", "\n a"):
        want = {i for i, t, tags_ in rows if needle.lower() in (t or "").lower() or any(needle.lower() in (x or "").lower() for x in tags_ or ())}
        assert {r.id for r in indexes.search_trigrams(df, "id", fields, path, needle).collect()} == want, needle
    found = indexes.candidates(spark, path, "needle", ["t"])
    assert [r.key for r in found.collect()] == [9000]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(gram" in plan


# scans and pairs


def test_scans_by_buckets_equal_one_window(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "a", "b"]), rng.randint(0, 50), i, rng.choice([None, rng.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    got = windows.scanned(
        df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), {"s": F.coalesce("v", F.lit(0))}, {"all": F.col("v")}, {"prior": "v", "prior_id": "id"}, {"next": "v"}
    )
    assert got.columns == ["k", "t", "id", "v", "s", "all", "prior", "prior_id", "next"]
    told = {r.id: tuple(r)[4:] for r in got.collect()}
    for k in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        total = sum(r[3] or 0 for r in own)
        for n, r in enumerate(own):
            prior, after = own[n - 1] if n else None, own[n + 1] if n + 1 < len(own) else None
            assert told[r[2]] == (sum(x[3] or 0 for x in own[: n + 1]), total, prior and prior[3], prior and prior[2], after and after[3])
    assert len(told) == 500


@pytest.mark.parametrize("directed", [True, False])
def test_pairs_in_blocks(spark, directed):
    rng = random.Random(3)
    rows = list({(e, rng.randint(0, 60)) for e in (1, 2, 3) for _ in range(20 * e * e)}) + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "event_id long, uid long")
    met = {e: sorted(u for x, u in rows if x == e) for e in (1, 2, 3)}
    want = Counter((e, a, b) for e, us in met.items() for a, b in combinations(us, 2))
    want = want + Counter({(e, b, a): n for (e, a, b), n in want.items()}) if directed else want
    for block in (7, 30, 2000):
        assert Counter(map(tuple, social.pairs(df, directed, block).collect())) == want


def test_one_large_event_is_the_work_of_many_tasks(spark):
    members = spark.range(20_000).selectExpr("1L AS event_id", "id AS uid").unionByName(spark.range(5).selectExpr("2L AS event_id", "id AS uid"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        met = social.pairs(members.filter("uid % 4 = 0"), False, block=500)
        shares = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(shares) == 5000 * 4999 // 2 + 1 and max(shares) < 0.35 * sum(shares)


def test_small_events_are_dealt_by_their_pairs(spark):
    """Few members make many pairs: tasks go by the pairs, and are not joined again because they read little."""
    members = spark.range(4000).selectExpr("id % 400 AS event_id", "id AS uid").unionByName(spark.range(500).selectExpr("CAST(NULL AS LONG) AS event_id", "id AS uid"))
    shares = [r["count"] for r in social.pairs(members, per_task=1000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 400 * 10 * 9 and len(shares) > 30 and max(shares) < 4000


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("size", [60, 1000, 10**9])
def test_newest_shared_events(spark, directed, size):
    """Pairs that the newest events fill, pairs that they don't, and pairs that met long ago only."""
    rng = random.Random(5)
    rows = list({(e, int(12 * rng.random() ** 2)) for e in range(200) for _ in range(6)} | {(e, 20 + e % 3) for e in range(9)} | {(e, 30) for e in range(9)}) + [(None, 1), (None, 2), (3, None)]
    met = {}
    for e in range(200):
        for a, b in combinations(sorted(u for x, u in rows if x == e and u is not None), 2):
            for pair in ((a, b), (b, a)) if directed else ((a, b),):
                met.setdefault(pair, []).append(e)
    want = Counter((e, *pair) for pair, es in met.items() for e in sorted(es)[-5:])
    assert Counter(map(tuple, social.newest_shared(spark.createDataFrame(rows, "event_id long, uid long"), 5, directed, size).collect())) == want
    assert social.newest_shared(spark.createDataFrame([], "event_id long, uid long"), 5, directed, size).count() == 0


def test_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """Distinct members and what is joined for impressions are made in tasks of bounded size, whatever the session's partitions."""
    want = sorted(map(tuple, tables.impressions(spark, sf_dir).collect()))
    monkeypatch.setattr(tables, "ROWS", 500)
    assert tables.members(spark, sf_dir).rdd.getNumPartitions() == -(-tables.table(spark, sf_dir, "lineitem").count() // 500)
    line = tables.table(spark, sf_dir, "lineitem")
    assert tables.dealt(line, "l_orderkey").rdd.getNumPartitions() == -(-line.count() // 500)
    assert sorted(map(tuple, tables.impressions(spark, sf_dir).collect())) == want


def test_noise_in_linear_time(spark):
    noisy = lambda s: spark.createDataFrame([(s,)], "s string").select(text.is_noise(F.col("s")).alias("x")).first().x
    assert noisy("aaaaaab") and not noisy("aaaabbb") and noisy("😀" * 9 + "a") and not noisy("aaaaa") and noisy("aa") and noisy(None)
    assert not noisy("abababab") and noisy("\n" + "é" * 8 + "ab") and not noisy("é" * 7 + "abc") and noisy("é" * 8 + "abc")
    long = "".join(chr(0x4E00 + i % 15_000) for i in range(40_000))
    noisy("warm up, please")
    began = time.perf_counter()
    assert not noisy(long)
    assert time.perf_counter() - began < 2
