"""Queries of the ways in and of upkeep: session names, encoding, noise, scoped deletes, fallbacks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import embedding, text
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.plans.recall import first_vector
from tidemark.plans.registry import query
from tidemark.plans.social import _PROJECTED, _projected
from tidemark.sources.tables import IMPRESSIONS, MEMORIES, impressions, memories, table


@query(
    "SELECT event_id, CASE WHEN event_type <> 'signup' THEN 'chat:' || event_type ELSE 'chat:private:' || user_id END AS session_id FROM events"
)
def session_names(spark, sf_dir):
    group = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.session_id(F.lit("chat"), group, F.col("user_id").cast("string")).alias("session_id"))


@query()
def encode_embedding(spark, sf_dir):
    """Vectors of all memories from group, language and text: what a full reindex writes."""
    whole = F.concat_ws(" ", "group_id", "lang", "text")
    return memories(spark, sf_dir).select("event_id", embedding.encoder(embedding.hashed)(whole).alias("embedding"))


@query(
    "SELECT label, i::INTEGER AS i, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL"
)
def centroid(spark, sf_dir):
    """Mean vectors, one row per place: partial sums meet, never the vectors."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    "SELECT event_id, 'memory' AS kind FROM memories WHERE group_id <> 'src3' UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM memories WHERE group_id = 'src3')",
    MEMORIES,
)
def delete_group(spark, sf_dir):
    """A group's memories go, and their vectors with them."""
    rows = memories(spark, sf_dir, text=False)
    gone = rows.filter("group_id = 'src3'").select(F.col("event_id").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")
    return rows.filter("group_id <> 'src3'").select("event_id", F.lit("memory").alias("kind")).unionByName(vectors.select(F.col("vec_id").alias("event_id"), F.lit("vector").alias("kind")))


@query("SELECT event_id FROM memories WHERE is_locked OR salience >= 0.3", MEMORIES)
def cleanup_low_salience(spark, sf_dir):
    return memories(spark, sf_dir, text=False).filter("is_locked OR salience >= 0.3").select("event_id")


@query(
    "SELECT vec_id AS event_id, round(1.0::DOUBLE / 61, 6) AS score FROM (SELECT vec_id FROM embeddings, (SELECT embedding::DOUBLE[] AS t FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY list_cosine_similarity(embedding::DOUBLE[], t) DESC, vec_id LIMIT 20)"
)
def vector_fallback(spark, sf_dir):
    """Without a lexical hit the nearest vectors stand in, all with the same score."""
    lexical = R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["zzzxqj"]).select(F.col("doc_id").alias("event_id"), F.lit(1.0).alias("score"))
    nearest = R.knn(table(spark, sf_dir, "embeddings"), "vec_id", first_vector(spark, sf_dir), 20)
    flat = nearest.select(F.col("vec_id").alias("event_id"), F.round(F.lit(1 / (R.RRF_K + 1)), 6).alias("score"))
    # one row, so the branch is taken inside the plan
    empty = lexical.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
    return lexical.unionByName(flat.join(F.broadcast(empty), F.col("empty")).drop("empty"))


_LABEL = "CASE WHEN benevolence >= 0 THEN '亲和' WHEN power >= 0 THEN '支配' ELSE '冷淡' END"


@query(
    f""", told AS (SELECT observer, scope, subject::VARCHAR AS uid, {_LABEL} AS label, n FROM impressions),
heads AS (SELECT observer, scope, sum(n)::BIGINT AS k FROM told GROUP BY ALL),
people AS (SELECT DISTINCT observer, uid FROM told),
every AS (SELECT observer, scope, 'n' || uid AS name, label, 0 AS late, uid FROM told
  UNION ALL SELECT h.observer, h.scope, 'n' || p.uid, '未知', 1, 'n' || p.uid FROM heads h JOIN people p USING (observer) WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.observer = h.observer AND t.scope = h.scope AND t.uid = p.uid)),
places AS (SELECT observer, scope, label, min((late, uid)) AS first, string_agg(name, ', ' ORDER BY late, uid) AS names FROM every GROUP BY ALL),
lines AS (SELECT observer, scope, string_agg('[' || names || '处于群体中的' || label || '位置]', ' | ' ORDER BY first) AS line FROM places GROUP BY ALL)
SELECT observer, scope, CASE WHEN observer % 5 > 0 THEN '群体情感动态整体偏向[' || CASE WHEN observer % 5 = 2 THEN '亲和' ELSE '主动' END || '] | [平均亲和度：' || printf('%+.2f', (k % 100) / 100.0::DOUBLE)
  || '；平均支配度：' || printf('%+.2f', CASE WHEN observer % 5 = 2 THEN 0.0 ELSE -((k % 37 + 1) / 100.0::DOUBLE) END) || '] | ' || line END AS mood FROM heads JOIN lines USING (observer, scope)""",
    IMPRESSIONS,
)
def mood_json(spark, sf_dir):
    """Moods from objects that a model wrote: positions as texts and as objects, in code fences or prose, without some fields, or broken off."""
    label = F.when(F.col("benevolence") >= 0, "亲和").when(F.col("power") >= 0, "支配").otherwise("冷淡")
    rows = impressions(spark, sf_dir).select("observer", "scope", F.col("subject").cast("string").alias("uid"), label.alias("label"), "n")
    quoted = F.concat(F.lit('"'), F.col("label"), F.lit('"'))
    kind = F.col("uid").cast("int") % 3
    value = F.when(kind == 0, F.concat(F.lit('{"orientation": '), quoted, F.lit(', "x": [1, {}]}'))).when(kind == 1, quoted).otherwise(F.concat(F.lit('{"position": '), quoted, F.lit("}")))
    entry = F.concat(F.lit('"'), F.col("uid"), F.lit('": '), value)
    told = rows.groupBy("observer", "scope").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("positions"), F.sum("n").alias("k"))
    fields = F.concat(F.lit('"benevolence": '), ((F.col("k") % 100) / 100).cast("string"), F.lit(', "positions": {'), F.col("positions"), F.lit("}"))
    rest = F.concat(F.lit(', "orientation": "主动", "power": -'), ((F.col("k") % 37 + 1) / 100).cast("string"))
    five = F.col("observer") % 5
    whole = F.concat(F.lit("{"), fields, F.when(five == 2, "").otherwise(rest), F.lit("}"))
    answer = F.when(five == 0, F.concat(F.lit("{"), fields)).when(five == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\n{bye}"))).otherwise(F.concat(F.lit("so: "), whole, F.lit(" ok")))
    people = rows.groupBy("observer").agg(F.collect_set(F.struct("uid", F.concat(F.lit("n"), "uid").alias("name"))).alias("people"))
    return told.join(people, "observer").select("observer", "scope", text.mood_text(answer, F.col("people")).alias("mood"))


@query(
    "SELECT orientation, string_agg(DISTINCT subject::VARCHAR, ',' ORDER BY subject::VARCHAR) AS names, count(*) FILTER (confidence < 0.3) AS unsure FROM projected WHERE scope = 'A' GROUP BY orientation",
    IMPRESSIONS, _PROJECTED,
)
def mood_positions(spark, sf_dir):
    """Who stands where in a group's mood, and how many impressions are unsure."""
    rows = _projected(spark, sf_dir).filter("scope = 'A'")
    found = rows.groupBy("orientation").agg(F.array_sort(F.collect_set(F.col("subject").cast("string"))).alias("s"), F.sum((F.col("confidence") < 0.3).cast("long")).alias("unsure"))
    return found.select("orientation", F.array_join("s", ",").alias("names"), "unsure")


@query(
    "SELECT c_custkey AS uid FROM customer JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS active FROM orders GROUP BY 1) USING (c_custkey) WHERE NOT (active <= TIMESTAMP '1997-01-01') ORDER BY active DESC, uid"
)
def stale_persona(spark, sf_dir):
    """People who were active since their last synthesis, the latest first."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("active"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey").filter("NOT (active <= TIMESTAMP_NTZ '1997-01-01')")
    return rows.orderBy(F.col("active").desc(), "c_custkey").select(F.col("c_custkey").alias("uid"))


@query(
    "SELECT event_id, group_id FROM (SELECT * FROM (SELECT event_id, group_id, n_chars, start_time, is_locked FROM memories UNION ALL SELECT -1, 'src3', 200, 1e9, false), (SELECT 1)) WHERE true "
    "QUALIFY is_locked OR NOT (sum(CASE WHEN NOT is_locked THEN n_chars ELSE 0 END) OVER (PARTITION BY group_id) > 60000 AND sum(CASE WHEN NOT is_locked THEN n_chars ELSE 0 END) OVER (PARTITION BY group_id) "
    "- coalesce(sum(n_chars) OVER (PARTITION BY group_id, is_locked ORDER BY start_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 55000)",
    MEMORIES,
)
def remember(spark, sf_dir):
    """A memory put in directly; then the history of its group is pruned like any other."""
    from tidemark.operators.windows import prune

    rows = memories(spark, sf_dir, text=False).select("event_id", "group_id", "n_chars", "start_time", "is_locked")
    new = spark.createDataFrame([(-1, "src3", 200, 1e9, False)], rows.schema)
    return prune(L.upsert(rows, new, ["event_id"]), "group_id", ["start_time", "event_id"], "n_chars", "is_locked", 60_000, 5_000, F.floor(F.col("start_time") / 3_600_000)).select("event_id", "group_id")
