"""Queries of recall over whole sets of questions: every row whose id is divisible by 100 is one, against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import indexes as I
from tidemark.operators import questions as Q
from tidemark.operators import retrieval as R
from tidemark.operators import tags as T
from tidemark.operators.lineage import shared_folder
from tidemark.plans.recall import _LEXICAL, K, TERMS
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES, memories, table

_BATCH = """dwords AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents
), dtf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM dwords) GROUP BY ALL),
ddf AS (SELECT term, count(*) AS df FROM dtf GROUP BY term),
dstats AS (SELECT count(*) AS n, avg(len(w)) AS average FROM dwords),
bm25_batch AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.len / average))) AS score
  FROM dtf q JOIN ddf USING (term) JOIN dtf d USING (term), dstats WHERE q.doc_id % 100 = 0 GROUP BY ALL
), bm25_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm25_batch)"""
_KNN = """knn_ranked AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20)"""


def _asked_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(R.word_list(F.col("text")))).alias("term"))


def _asked_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("SELECT query_id, doc_id, round(score, 4) AS score FROM bm25_ranked WHERE rank <= 20", _BATCH)
def bm25_batch(spark, sf_dir):
    """Documents most like each asked one, by all of its words."""
    top = Q.bm25_batch(table(spark, sf_dir, "documents"), "doc_id", "text", _asked_words(spark, sf_dir), K)
    return top.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM knn_ranked", _KNN)
def knn_batch(spark, sf_dir):
    top = R.knn_batch(table(spark, sf_dir, "embeddings"), "vec_id", _asked_vectors(spark, sf_dir), K)
    return top.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    """, fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (
  SELECT query_id, doc_id AS id, rank FROM bm25_ranked WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank FROM knn_ranked) GROUP BY ALL)
SELECT query_id, id, round(rrf, 6) AS rrf FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) <= 10""",
    _BATCH, _KNN,
)
def hybrid_batch(spark, sf_dir):
    """Both searches for all questions, fused by rank; a question without a vector has its words alone."""
    words = Q.bm25_batch(table(spark, sf_dir, "documents"), "doc_id", "text", _asked_words(spark, sf_dir), K)
    near = R.knn_batch(table(spark, sf_dir, "embeddings"), "vec_id", _asked_vectors(spark, sf_dir), K)
    lists = words.select("query_id", F.col("doc_id").alias("id"), "rank").unionByName(near.select("query_id", F.col("vec_id").alias("id"), "rank"))
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (R.RRF_K + F.col("rank"))).alias("rrf"))
    n = F.row_number().over(R.W.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "id"))
    return fused.withColumn("n", n).filter("n <= 10").select("query_id", "id", F.round("rrf", 6).alias("rrf"))


@query("SELECT doc_id, round(score, 6) AS score FROM lexical", _LEXICAL)
def bm25_postings(spark, sf_dir):
    """The index is written by term and read by the terms of one question."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    R.write_postings(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return R.search_postings(spark, path, "doc_id", TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "SELECT event_id, salience FROM memories WHERE status = 'active' AND event_id IN (SELECT doc_id FROM lexical ORDER BY score DESC, doc_id LIMIT 20) ORDER BY salience DESC, event_id",
    _LEXICAL, MEMORIES,
)
def bm25_then_filter(spark, sf_dir):
    """The best hits are taken before the filter and shown by salience: fewer than asked for may be left."""
    hits = R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    top = hits.orderBy(F.col("score").desc(), "doc_id").limit(K).select(F.col("doc_id").alias("event_id"))
    rows = memories(spark, sf_dir, text=False).filter("status = 'active'").join(F.broadcast(top), "event_id", "left_semi")
    return rows.orderBy(F.col("salience").desc(), "event_id").select("event_id", "salience")


@query(
    "SELECT v.vec_id AS query_id, c.vec_id AS tag, round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings c "
    "WHERE v.vec_id % 100 = 0 AND c.vec_id % 3 = 1 AND list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.3 "
    "QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) <= 5"
)
def tag_nearest(spark, sf_dir):
    """The nearest five canonical tags (here a third of the vectors) over a threshold."""
    canonical = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 1")
    top = R.knn_batch(canonical, "vec_id", _asked_vectors(spark, sf_dir), 5).filter("similarity >= 0.3")
    return top.select("query_id", F.col("vec_id").alias("tag"), F.round("similarity", 6).alias("similarity"))


_NEAR = """near AS (
  SELECT v.vec_id, c.vec_id AS other, list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings v JOIN embeddings c ON c.vec_id < v.vec_id WHERE s >= 0.3
), placed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, coalesce((SELECT list(other) FROM near WHERE near.vec_id = e.vec_id), []) AS others FROM embeddings e),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS canonical
  UNION ALL SELECT p.n, CASE WHEN list_has_any(w.canonical, p.others) THEN w.canonical ELSE list_append(w.canonical, p.vec_id) END FROM walk w JOIN placed p ON p.n = w.n + 1
), canonical AS (SELECT unnest(canonical) AS vec_id FROM (SELECT canonical FROM walk ORDER BY n DESC LIMIT 1))"""


@query(
    "SELECT e.vec_id, CASE WHEN c.vec_id IS NULL THEN (SELECT other FROM near JOIN canonical k ON k.vec_id = other WHERE near.vec_id = e.vec_id ORDER BY s DESC, other LIMIT 1) ELSE e.vec_id END AS tag, "
    "c.vec_id IS NOT NULL AS registered FROM embeddings e LEFT JOIN canonical c ON c.vec_id = e.vec_id",
    _NEAR,
)
def tag_align(spark, sf_dir):
    """Tags in order: each takes the most similar canonical tag before it, or is registered as canonical for those behind it."""
    return T.register(table(spark, sf_dir, "embeddings"), "vec_id", 0.3).select(F.col("id").alias("vec_id"), "tag", "registered")


@query("SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM knn_ranked", _KNN)
def cell_knn(spark, sf_dir):
    """The nearest of all vectors by a written index of cells, exact: cells are read until none can hold a nearer one."""
    vectors, path = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    I.write_cells(vectors, "vec_id", I.fit_cells(vectors, "vec_id", 16), path)
    return I.search_cells(spark, path, "vec_id", _asked_vectors(spark, sf_dir), K).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query()
def cell_knn_recall(spark, sf_dir):
    """How many of the nearest twenty a search of twelve of sixteen cells finds, for each question."""
    vectors, path = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    I.write_cells(vectors, "vec_id", I.fit_cells(vectors, "vec_id", 16), path)
    asked = _asked_vectors(spark, sf_dir)
    some = I.search_cells(spark, path, "vec_id", asked, K, probes=12).select("query_id", "vec_id")
    every = R.knn_batch(vectors, "vec_id", asked, K).select("query_id", "vec_id")
    hits = every.join(some.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"))


_NEEDLES = ("idiot", "src1", "Clown", "fr")


@query(
    "SELECT needle, event_id FROM memories, (VALUES ('idiot'), ('src1'), ('Clown'), ('fr')) q(needle) WHERE contains(lower(text), lower(needle)) "
    "OR contains(lower(lang), lower(needle)) OR contains(lower(group_id), lower(needle)) OR contains(lower(status), lower(needle))",
    MEMORIES,
)
def substring_indexed(spark, sf_dir):
    """Needles in texts, tags (language, status) and participants by an index of trigrams; one of two characters reads all rows."""
    rows, path = memories(spark, sf_dir), f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    fields = {"text": F.col("text"), "tags": F.array("lang", "status"), "participants": F.array("group_id")}
    I.write_trigrams(rows, "event_id", fields, path)
    return I.search_needles(rows, "event_id", fields, path, list(_NEEDLES))
