"""Queries from messages to episodes: sessions, count windows, states, extraction by rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import clusters
from tidemark.operators import windows as O
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES, memories, table
from tidemark.streaming import sessions as S

_SESSIONS = """sessions AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR
      OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)
)"""


def _sessions(spark, sf_dir):
    return O.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "2 HOURS")


@query("SELECT event_id, user_id, session FROM sessions", _SESSIONS)
def sessionize_gap(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_id", "user_id", "session")


@query(
    "SELECT user_id, session, count(*) AS n, date_sub('second', min(ts), max(ts)) AS seconds, round(avg(value), 8) AS mean_value, "
    "count(DISTINCT event_type) AS kinds FROM sessions GROUP BY ALL",
    _SESSIONS,
)
def session_summary(spark, sf_dir):
    return (
        _sessions(spark, sf_dir).groupBy("user_id", "session")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("seconds"),
            F.round(F.avg("value"), 8).alias("mean_value"),
            F.countDistinct("event_type").alias("kinds"),
        )
    )


@query(
    "SELECT event_id, session, coalesce(lag(session) OVER w <> session, true) AS is_first, coalesce(lead(session) OVER w <> session, true) AS is_last, "
    "coalesce(lag(ts::DATE) OVER w <> ts::DATE, true) AS new_day FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    _SESSIONS,
)
def session_window_rows(spark, sf_dir):
    rows = O.session_rows(_sessions(spark, sf_dir), "user_id", "ts", "event_id")
    return rows.select("event_id", "session", "is_first", "is_last", "new_day")


@query(
    "SELECT event_type, user_id, session, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, count(*) AS n FROM sessions GROUP BY event_type, user_id, session HAVING count(*) >= 2",
    _SESSIONS,
)
def thread_session_ranges(spark, sf_dir):
    return (
        _sessions(spark, sf_dir).groupBy("event_type", "user_id", "session")
        .agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
    )


@query(
    """, rows_ AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT user_id, n, event_id AS first_message, event_id AS last_message, ts AS started, ts AS ended, 1 AS messages, NULL::VARCHAR AS reason FROM rows_ WHERE n = 1
  UNION ALL
  SELECT user_id, n, CASE WHEN reason IS NULL THEN first_message ELSE event_id END, event_id, CASE WHEN reason IS NULL THEN started ELSE ts END, ts, CASE WHEN reason IS NULL THEN messages + 1 ELSE 1 END, reason
  FROM (SELECT r.user_id, r.n, r.event_id, r.ts, w.first_message, w.started, w.messages, CASE WHEN r.ts - w.ended > INTERVAL 6 HOUR THEN 'gap' WHEN w.messages >= 50 THEN 'count'
      WHEN r.ts - w.started >= INTERVAL 1 DAY THEN 'duration' WHEN w.messages >= 60 THEN 'rounds' END AS reason
    FROM walk w JOIN rows_ r ON r.user_id = w.user_id AND r.n = w.n + 1)
), closed AS (SELECT *, lead(reason) OVER (PARTITION BY user_id ORDER BY n) AS next_reason, lead(n) OVER (PARTITION BY user_id ORDER BY n) IS NULL AS final FROM walk)
SELECT user_id::VARCHAR AS session_id, first_message, last_message, started, ended, messages::BIGINT AS messages, coalesce(next_reason, 'end') AS close_reason FROM closed WHERE next_reason IS NOT NULL OR final""",
    "one AS (SELECT 1)",
)
def session_close_rules(spark, sf_dir):
    """Windows of each user under all close rules (gap, count, duration, rounds), without embeddings."""
    messages = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("ts"), F.col("event_id").alias("message_id")
    )
    return S.close_windows(messages, S.Rules(gap_s=6 * 3600, duration_s=86_400, max_messages=10, rounds=30, no_encoder=50))


@query(
    "SELECT conv_id, turn, CASE WHEN n >= 0.8 * 8 THEN 'EVICTION' WHEN role = 'system' THEN 'RECALL' ELSE 'FOCUSED' END AS state "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)"
)
def vcm_state(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    state = O.context_state(F.col("n"), 8, F.col("role") == "system", F.lit(False))
    return table(spark, sf_dir, "conversations").withColumn("n", n).select("conv_id", "turn", state.alias("state"))


@query(
    "SELECT user_id, bucket, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT *, "
    "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS bucket FROM events) GROUP BY ALL HAVING count(*) = 10"
)
def bigfive_count_window(spark, sf_dir):
    """Full windows of ten messages per user: when the trait scorer runs."""
    rows = O.count_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10)
    out = rows.groupBy("user_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )
    return out.filter("n = 10")


@query(
    "SELECT conv_id, count(*) // 2 AS rounds, least(100, round(100.0::DOUBLE * (count(*) // 2) / 3))::INTEGER AS progress FROM conversations GROUP BY conv_id"
)
def round_progress(spark, sf_dir):
    rounds = F.floor(F.col("n") / 2)
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("conv_id", rounds.alias("rounds"), F.least(F.lit(100), F.round(100.0 * rounds / 3)).cast("int").alias("progress"))


@query(
    """, steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
  least(5.0::DOUBLE, 0.5 * (length(text) % 13)) AS delta FROM conversations),
fold AS (
  SELECT conv_id, n, 20 * tanh(delta / 20) AS x FROM steps WHERE n = 1
  UNION ALL SELECT s.conv_id, s.n, 20 * tanh((f.x * 0.9 + s.delta) / 20) FROM fold f JOIN steps s ON s.conv_id = f.conv_id AND s.n = f.n + 1
)
SELECT conv_id, round(x, 6) AS state FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1""",
    "one AS (SELECT 1)",
)
def soul_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")  # a conversation's turns: short by nature
    )
    deltas = F.transform("t", lambda t: F.least(F.lit(5.0), 0.5 * (F.length(t.text) % 13)))
    return turns.select("conv_id", F.round(O.elastic_fold(deltas, 0.1), 6).alias("state"))


_WORD_SQL = """regexp_split_to_array(text, '[\\s，。！？、,!?]+')"""
_TAGS = f"""tag_words AS (
  SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({_WORD_SQL}) AS w FROM conversations)
  WHERE length(w) BETWEEN 2 AND 12 AND NOT regexp_full_match(w, '[0-9]+') AND w[1] NOT IN ('@', '#')
    AND NOT starts_with(w, 'http://') AND NOT starts_with(w, 'https://') AND NOT starts_with(w, 'qq=') GROUP BY ALL
), top_tags AS (SELECT * FROM tag_words QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) <= 5)"""


def _top_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(text.words(F.col("text"))).alias("w"))
    counts = words.filter(text.is_word_tag(F.col("w"))).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return O.latest_per_group(counts, "conv_id", [F.col("n").desc(), "w"], 5)


@query("SELECT conv_id, w AS tag, n FROM top_tags", _TAGS)
def word_freq_tags(spark, sf_dir):
    return _top_words(spark, sf_dir).select("conv_id", F.col("w").alias("tag"), "n")


@query(
    """, firsts AS (SELECT conv_id, count(*) AS n, min_by(trim(text), (turn, role, text)) FILTER (trim(text) <> '') AS head FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(substr(head, 1, 30), '（无内容）') AS topic, n AS messages, round(least(0.3 + 0.01 * n, 0.7), 3)::DOUBLE AS salience, 0.2::DOUBLE AS confidence, tags
FROM firsts LEFT JOIN (SELECT conv_id, string_agg(w, ',' ORDER BY n DESC, w) AS tags FROM top_tags GROUP BY conv_id) USING (conv_id)""",
    _TAGS,
)
def fallback_extract(spark, sf_dir):
    """Episodes by rule: topic from the first words, tags from the most frequent ones."""
    rows = table(spark, sf_dir, "conversations")
    clean = F.trim("text")
    heads = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.min_by(F.when(clean != "", clean), F.when(clean != "", F.struct("turn", "role", "text"))).alias("head")
    )
    tags = _top_words(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))).alias("t"))
    tags = tags.select("conv_id", F.array_join(F.transform("t", lambda t: t.w), ",").alias("tags"))
    return heads.join(tags, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.substring("head", 1, 30), F.lit("（无内容）")).alias("topic"),
        "messages",
        F.round(F.least(0.3 + 0.01 * F.col("messages"), F.lit(0.7)), 3).alias("salience"),
        F.lit(0.2).alias("confidence"),
        "tags",
    )


@query(
    "SELECT event_id, lag(event_id) OVER (PARTITION BY group_id ORDER BY start_time, event_id) AS inherit_from, "
    "lead(event_id) OVER (PARTITION BY group_id ORDER BY start_time, event_id) AS shifts_to, CASE WHEN lead(event_id) OVER (PARTITION BY group_id ORDER BY start_time, event_id) IS NOT NULL THEN right(text, 30) END AS preview FROM memories WHERE status = 'active'",
    MEMORIES,
)
def episode_chain(spark, sf_dir):
    """Each active memory's predecessor, which it inherits from, and successor, in its group, and the last words before the shift."""
    active = memories(spark, sf_dir).filter("status = 'active'").select("event_id", "group_id", "start_time", F.substring("text", -30, 30).alias("preview"))
    thousand_hours = F.floor(F.col("start_time") / 3_600_000)
    met = O.scanned(active, ["group_id"], ["start_time", "event_id"], thousand_hours, before={"inherit_from": "event_id"}, after={"shifts_to": "event_id"})
    return met.select("event_id", "inherit_from", "shifts_to", F.when(F.col("shifts_to").isNotNull(), F.col("preview")).alias("preview"))


@query(
    """, points AS (SELECT (label * 1000000 + (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100)::BIGINT AS session_id, vec_id AS message_id, embedding::DOUBLE[] AS e FROM embeddings),
spans AS (SELECT session_id, greatest(max(message_id) - min(message_id), 1e-9) AS span FROM points GROUP BY session_id),
near AS (SELECT a.session_id, a.message_id AS u, b.message_id AS v FROM points a JOIN points b ON a.session_id = b.session_id AND a.message_id <> b.message_id
  JOIN spans s ON s.session_id = a.session_id WHERE 1 - list_cosine_similarity(a.e, b.e) + 0.05 * abs(a.message_id - b.message_id) / span <= 0.45),
reach AS (SELECT session_id, u AS message_id, u AS root FROM near UNION SELECT n.session_id, n.v, r.root FROM reach r JOIN near n ON n.session_id = r.session_id AND n.u = r.message_id)
SELECT session_id, message_id, coalesce(cluster, -1) AS cluster FROM points LEFT JOIN (SELECT session_id, message_id, min(root) AS cluster FROM reach GROUP BY ALL) USING (session_id, message_id)""",
    "one AS (SELECT 1)",
)
def dbscan_partition(spark, sf_dir):
    """Density clusters within windows of a hundred vectors of a label, named by their smallest member; noise is -1.

    With two samples every point that has a neighbour is a core, so clusters are the components of the near pairs.
    """
    n = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.floor((n - 1) / 100).alias("n"))
    vectors = vectors.select(
        (F.col("label") * 1_000_000 + F.col("n")).cast("long").alias("session_id"), F.col("vec_id").alias("message_id"),
        F.col("vec_id").cast("double").alias("ts"), "embedding",
    )
    first = F.min("message_id").over(W.partitionBy("session_id", "cluster"))
    return clusters.dbscan(vectors, eps=0.45, min_samples=2).withColumn("cluster", F.when(F.col("cluster") < 0, F.lit(-1).cast("long")).otherwise(first))
