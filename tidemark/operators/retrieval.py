"""Recall: lexical and vector search, rank fusion, reranking, threads, budgets, sampling.

All functions take and return DataFrames. Query terms and query vectors are parameters; everything else is data and
stays distributed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
WEIGHTS = (0.5, 0.1, 0.2)
HALF_LIFE_DAYS = 30.0
#: Keywords of broad and of specific questions.
MACRO = (
    "最近", "这段时间", "这周", "本周", "这个月", "上周", "上个月",
    "总结", "概括", "整体", "大概", "发生了什么", "有什么事", "都做了什么",
    "最近怎么样", "一段时间", "过去", "回顾",
)
MICRO = (
    "具体", "说了什么", "怎么说", "什么时候", "为什么", "怎么了", "详细",
    "哪次", "那次", "上次", "那时候",
)


def spaced_words(text: Column) -> Column:
    """The longest runs of letters and digits of the lower-cased text, one space between them."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def count_words(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def count_term(spaced: Column, term: str) -> Column:
    """How often a word stands among words with one space between them; what is no single word never does."""
    if not term.isalnum():
        return F.lit(0)
    # with a space of its own on either side, no occurrence shares one with the next
    apart = F.concat(F.lit(" "), F.replace(spaced, F.lit(" "), F.lit("  ")), F.lit(" "))
    found = (F.length(apart) - F.length(F.replace(apart, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)
    return F.when(F.contains(spaced, F.lit(term)), found.cast("int")).otherwise(0)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], match_all: bool = False) -> DataFrame:
    """key, score: one row per row of ``docs`` with a hit. Rows are counted where they stand; only one row of sums is fetched."""
    wanted = sorted({t.lower() for t in terms})
    spaced = docs.select(key, spaced_words(F.col(text)).alias("w"))
    counts = [count_term(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(wanted)]
    sized = spaced.select(key, count_words(F.col("w")).alias("len"), *counts)
    held = [F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)) for i in range(len(wanted))]
    n, average, *df = sized.agg(F.count(F.lit(1)), F.avg("len"), *held).first()
    score, matched = F.lit(0.0), F.lit(0)
    for i, own in enumerate(df):
        tf, idf = F.col(f"tf{i}"), max(1e-6, math.log((n - (own or 0) + 0.5) / ((own or 0) + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
        matched = matched + F.when(tf > 0, 1).otherwise(0)
    least = len(wanted) if match_all else 1
    # a filter would be pushed below the counts and repeat their work for every term
    return sized.select(key, F.explode(F.when(matched >= least, F.array(score))).alias("score"))


def substring_hits(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """Rows whose lower-cased text holds any of the terms."""
    return docs.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t.lower())) for t in terms)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def knn(vectors: DataFrame, key: str, query: list[float], k: int | None) -> DataFrame:
    """key, similarity: the nearest ``k`` (all if None); ties by key. A top-k per task, then one merge."""
    target = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("*", cosine(F.col("embedding"), target).alias("similarity"))
    return scored if k is None else scored.orderBy(F.col("similarity").desc(), key).limit(k)


def ranked(df: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """key, rank from 1, of the best ``limit`` rows."""
    top = df.orderBy(F.col(score).desc(), key).limit(limit)
    return top.select(key, F.row_number().over(W.orderBy(F.col(score).desc(), key)).alias("rank"))


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """key, rrf: sums of 1 / (k + rank) over ranked lists."""
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def recency(days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.exp(-math.log(2) * days / half_life)


def rerank(candidates: DataFrame, now: float, weights=WEIGHTS) -> DataFrame:
    """Adds ``score`` to candidates with rrf, salience and start_time; the candidates are a bounded few."""
    top = F.max("rrf").over(W.partitionBy())
    days = (F.lit(now) - F.col("start_time")) / 86400
    return candidates.withColumn(
        "score", weights[0] * F.col("rrf") / top + weights[1] * F.col("salience") + weights[2] * recency(days)
    )


def granularity(query: Column) -> Column:
    hits = lambda words: reduce(lambda a, b: a + b, (F.when(F.contains(query, F.lit(w)), 1).otherwise(0) for w in words))
    macro, micro = hits(MACRO), hits(MICRO)
    return F.when(macro > micro, "macro").when(micro > macro, "micro").otherwise("both")


def tier_limits(kind: str, limit: int) -> tuple[int, int]:
    """How many narratives and episodes a question of this kind wants."""
    return {"macro": (min(4, limit), max(limit - 2, 1)), "micro": (1, limit)}.get(kind, (min(2, limit), limit))


def expand_threads(anchors: DataFrame, memories: DataFrame) -> DataFrame:
    """event_id, place: narratives, the best episode, its parents, its children, the other anchors; first places win.

    ``anchors``: event_id, event_type, score.
    """
    order = F.row_number().over(W.partitionBy("event_type").orderBy(F.col("score").desc(), "event_id"))
    anchors = anchors.withColumn("n", order)
    tier = F.when(F.col("event_type") == "narrative", 0).when(F.col("n") == 1, 1).otherwise(4)
    own = anchors.select("event_id", tier.alias("tier"), F.col("n").cast("long").alias("n"))
    best = F.broadcast(anchors.filter("event_type <> 'narrative' and n = 1").select(F.col("event_id").alias("best")))
    links = memories.select("event_id", "parent").filter("parent is not null")
    parents = links.join(best, F.col("event_id") == F.col("best")).select(F.col("parent").alias("event_id"), F.lit(2).alias("tier"), F.col("parent").alias("n"))
    children = links.join(best, F.col("parent") == F.col("best")).select("event_id", F.lit(3).alias("tier"), F.col("event_id").alias("n"))
    rows = own.unionByName(parents).unionByName(children)
    first = rows.groupBy("event_id").agg(F.min(F.struct("tier", "n")).alias("at"))
    place = F.row_number().over(W.orderBy("at.tier", "at.n", "event_id"))
    return first.select("event_id", "at.tier", place.cast("long").alias("place"))


def fill_budget(rows: DataFrame, cost: Column, budget: int, header: int, partition: list[str], key: str) -> DataFrame:
    """The greedy prefix by falling salience whose cost, with the header's, stays within the budget. A row costs one at least.

    So no more rows than the budget can be in it: tasks keep as many of each group, and only those are brought together.
    """
    order = W.partitionBy(*partition).orderBy(F.col("salience").desc(), key)
    few = rows.withColumn("cost", cost).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= budget - header)
    used = header + F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("used", used).filter(F.col("used") <= budget).drop("_n")


def sample_softmax(rows: DataFrame, score: str, key: str, k: int, temperature: float, seed: int) -> DataFrame:
    """k rows without replacement, by softmax: the Gumbel-top-k trick. The noise is a hash of key and seed, so it repeats."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 13)  # 52 bits
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    noisy = F.col(score) / temperature - F.log(-F.log(uniform))
    return rows.orderBy(noisy.desc(), key).limit(k)


def choose(rows: DataFrame, score: str, key: str, limit: int, temperature: float | None = None, seed: int = 0) -> DataFrame:
    """What a search hands on of its candidates: the best, or, with a temperature, a sample by softmax of their scores."""
    if temperature is None:
        return rows.orderBy(F.col(score).desc(), key).limit(limit)
    return sample_softmax(rows, score, key, limit, temperature, seed)


# many questions at once

#: Files of a bucket of postings at most; words that a task turns into lists at a time.
FILES, LIST_WORDS = 8, 1_000_000
#: Query vectors that travel to the tasks together, and the numbers that a task compares at a time.
QUERY_BLOCK, MATRIX = 4096, 4_000_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _term_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, keys, lens, tfs: which of some rows hold a term, how long they are, and how often it stands there. Rows are counted where they stand."""
    import numpy as np
    import pyarrow as pa

    def told(keys: pa.Array, words: pa.Array, length: np.ndarray) -> pa.RecordBatch:
        flat, n = words.flatten().dictionary_encode(), len(keys)
        pair = flat.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length)
        pair, tf = np.unique(pair, return_counts=True)
        term, row = pair // n, pair % n
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        ends = pa.array(np.append(first, len(term)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (keys.take(pa.array(row)), pa.array(length[row], pa.int32()), pa.array(tf, pa.int32()))]
        return pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(term[first])), *lists], names=["term", "keys", "lens", "tfs"])

    def run(batches):
        for b in batches:
            length = np.asarray(b.column("w").value_lengths().fill_null(0))
            part = np.cumsum(length, dtype=np.int64) // LIST_WORDS
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if length[at:end].any():
                    yield told(b.column("key").slice(at, end - at), b.column("w").slice(at, end - at), length[at:end])

    words = docs.select(F.col(key).alias("key"), word_list(F.col(text)).alias("w"))
    return words.mapInArrow(run, f"term string, keys array<{words.schema['key'].dataType.simpleString()}>, lens array<int>, tfs array<int>")


def _told(lists: DataFrame, key: str, *more: str) -> DataFrame:
    rows = lists.select("term", *more, F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lens").alias("len"), F.col("tfs").alias("tf"))))
    return rows.select("term", F.col("key").alias(key), "len", F.col("tf").cast("long").alias("tf"), *more)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, len, tf of each row of ``docs``: an index to be written once, by term, and read by the terms of the questions."""
    return _told(_term_lists(docs, key, text), key)


def write_postings(docs: DataFrame, key: str, text: str, path: str, buckets: int | None = None, per_bucket: int = 4_000_000) -> None:
    """The index as files by bucket of terms: a question reads the buckets of its terms, and of those the row groups that hold them.

    There are as many buckets as the words need; a bucket is several files, so the postings of a frequent term are not one task's.
    Only lists of terms travel, once, to as many tasks as there are files, so that their rows are sorted in memory.
    """
    sizes = docs.select(word_list(F.col(text)).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("average"))
    n, average = sizes.first()
    buckets = buckets or max(1, math.ceil(n * (average or 0) / per_bucket))
    docs.sparkSession.createDataFrame([(n, average, buckets)], sizes.withColumn("buckets", F.lit(buckets)).schema).coalesce(1).write.parquet(f"{path}/sizes")
    lists = _term_lists(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    dealt = lists.repartition(buckets * FILES, "bucket", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(FILES)))
    _told(dealt, key, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")


def search_postings(spark, path: str, key: str, terms: list[str]) -> DataFrame:
    """key, score, matched (terms found) for one question, from a written index. The filter on terms reaches the scan."""
    n, average, buckets = spark.read.parquet(f"{path}/sizes").first()
    wanted = sorted({t.lower() for t in terms})
    held = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    places = sorted({r.b for r in spark.createDataFrame([(t,) for t in wanted], "term string").select(held.alias("b")).collect()})
    found = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*places) & F.col("term").isin(*wanted))
    found = found.groupBy("term", key, "len").agg(F.sum("tf").alias("tf"))  # rows of one key and length are one document
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per term of the question
    idf = reduce(lambda c, t: c.when(F.col("term") == t, max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))), sorted(df), F) if df else F.lit(0.0)
    return found.groupBy(key).agg(F.sum(_weight(idf, average)).alias("score"), F.count(F.lit(1)).alias("matched"))


def _weight(idf: Column, average) -> Column:
    tf, length = F.col("tf"), F.col("len")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def knn_batch(vectors: DataFrame, key: str, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, key, similarity, rank: the nearest ``k`` of all vectors for each of (query_id, embedding); ties by key.

    Questions travel in blocks of bounded size; a task keeps the best ``k`` of its rows for each, so what is shuffled
    doesn't grow with the vectors of a task. Vectors without length are as far as any: similarity 0.
    """
    import numpy as np
    import pyarrow as pa

    schema = f"query_id long, {key} long, similarity double"
    rows = vectors.select(F.col(key).cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).filter("embedding IS NOT NULL")
    n_blocks = max(1, -(-asked.count() // block))
    deal = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    found = None
    for number in range(n_blocks):
        some = sorted(asked.filter(deal == number).collect())
        ids = np.array([q.query_id for q in some], dtype=np.int64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit(np.array([q.embedding for q in some], dtype=float))))

        def run(batches, shared=shared):
            ids, asked_ = shared.value
            best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]
            for b in batches:
                own = b.column(key).to_numpy()
                if not len(own) or not len(ids):
                    continue
                units = _unit(np.stack(b.column("embedding").to_numpy(zero_copy_only=False)))
                step = max(1, MATRIX // len(own))
                for at in range(0, len(ids), step):
                    for j, s in enumerate(asked_[at : at + step] @ units.T, at):
                        best[j] = _best(best[j], s, own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(s) for s, _ in best])), pa.array(np.concatenate([n for _, n in best] or [np.empty(0, dtype=np.int64)])), pa.array(np.concatenate([s for s, _ in best] or [np.empty(0)]))],
                names=["query_id", key, "similarity"],
            )

        part = rows.filter("embedding IS NOT NULL").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _best(held, s, names, k: int):
    """The best ``k`` of those held and new ones, ties by name. Only what reaches the k-th best is sorted."""
    import numpy as np

    if len(held[0]) == k:
        near = s >= held[0][-1]
        s, names = s[near], names[near]
    s, names = np.concatenate([held[0], s]), np.concatenate([held[1], names])
    if len(s) > 4 * k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, names = s[near], names[near]
    top = np.lexsort((names, -s))[:k]
    return s[top], names[top]


def _unit(vectors):
    import numpy as np

    if not len(vectors):
        return vectors.reshape(0, 0)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
