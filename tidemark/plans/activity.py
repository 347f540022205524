"""Queries of the dashboard: counts, buckets, histograms, cards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import windows as O
from tidemark.plans.registry import query
from tidemark.sources.tables import IMPRESSIONS, MEMORIES, impressions, memories, table

#: A fixed "now": the end of the events.
NOW = "2024-01-31"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _long(c, name):
    return F.sum(c.cast("int")).cast("long").alias(name)


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30")
def daily_activity(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("day").desc()).limit(30)


@query("SELECT h::INTEGER AS hour, coalesce(n, 0) AS n FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1) USING (h)")
def hourly_pattern(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"SELECT this_week, last_week, this_week - last_week AS delta, CASE WHEN last_week > 0 THEN round(100.0::DOUBLE * abs(this_week - last_week) / last_week, 6) END AS pct FROM (SELECT "
    f"count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS this_week, count(*) FILTER (ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS last_week FROM events)"
)
def week_over_week(spark, sf_dir):
    now = F.expr(f"TIMESTAMP_NTZ '{NOW}'")
    week, two = now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 14 DAYS")
    ts = F.col("ts")
    both = _events(spark, sf_dir).agg(_long(ts > week, "this_week"), _long((ts <= week) & (ts > two), "last_week"))
    delta = F.col("this_week") - F.col("last_week")
    return both.select("*", delta.alias("delta"), F.when(F.col("last_week") > 0, F.round(100.0 * F.abs(delta) / F.col("last_week"), 6)).alias("pct"))


@query(
    "SELECT band, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT CASE WHEN salience < 0.3 THEN 'low' WHEN salience < 0.7 THEN 'mid' ELSE 'high' END AS band FROM memories) GROUP BY band",
    MEMORIES,
)
def salience_bands(spark, sf_dir):
    s = F.col("salience")
    band = F.when(s < 0.3, "low").when(s < 0.7, "mid").otherwise("high").alias("band")
    counts = memories(spark, sf_dir, text=False).groupBy(band).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("band", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("pct"))


@query("SELECT group_id, least(3, floor(4 * salience))::BIGINT AS quartile, count(*) AS n FROM memories GROUP BY ALL", MEMORIES)
def salience_quartiles(spark, sf_dir):
    quartile = F.least(F.lit(3).cast("long"), F.floor(4 * F.col("salience"))).alias("quartile")
    return memories(spark, sf_dir, text=False).groupBy("group_id", quartile).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT d::DATE AS day, coalesce(n, 0) AS n, top, coalesce(errors, false) AS errors FROM (SELECT unnest(generate_series(TIMESTAMP '{NOW}' - INTERVAL 7 DAY, TIMESTAMP '{NOW}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d) "
    "LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n, max(value) AS top, bool_or(event_type = 'error') AS errors FROM events GROUP BY 1) ON day = d::DATE"
)
def density_ribbon(spark, sf_dir):
    days = spark.sql(f"SELECT explode(sequence(DATE '{NOW}' - 7, DATE '{NOW}' - 1)) AS day")
    per_day = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.bool_or(F.col("event_type") == "error").alias("errors")
    )
    return days.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), "top", F.coalesce("errors", F.lit(False)).alias("errors"))


@query(
    "SELECT month, event_id FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS event_id, o_orderdate FROM orders) QUALIFY row_number() OVER (PARTITION BY month ORDER BY o_orderdate DESC, event_id) <= 50"
)
def events_by_month(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("event_id"), "o_orderdate")
    return O.latest_per_group(rows, "month", [F.col("o_orderdate").desc(), "event_id"], 50).select("month", "event_id")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type")
def source_threads(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))


@query(
    "SELECT event_type || ':' || CASE WHEN user_id % 5 = 0 THEN 'private' ELSE 'group' END AS group_key, count(*) AS n, max(ts) AS last_active, count(DISTINCT user_id) AS participants FROM events GROUP BY ALL"
)
def group_list(spark, sf_dir):
    key = F.concat("event_type", F.when(F.col("user_id") % 5 == 0, ":private").otherwise(":group")).alias("group_key")
    return _events(spark, sf_dir).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_active"), F.countDistinct("user_id").alias("participants")
    )


@query("SELECT o_custkey AS uid, c_name AS label, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL ORDER BY n DESC, uid LIMIT 8")
def top_participants(spark, sf_dir):
    top = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "uid").limit(8)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("label"))
    return names.join(F.broadcast(top), "uid", "right").select("uid", F.coalesce("label", F.col("uid").cast("string")).alias("label"), "n")


@query("SELECT user_id AS uid, count(*) AS n, max(ts) AS last_active FROM events GROUP BY 1")
def messages_by_uid(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_active"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 12")
def frequent_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(12)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_counts_all(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT group_id FROM memories", MEMORIES)
def distinct_groups(spark, sf_dir):
    return memories(spark, sf_dir, text=False).select("group_id").distinct()


@query(
    "SELECT count(*) AS n, round(avg(salience), 4) AS mean, round(min(salience), 4) AS low, round(max(salience), 4) AS high, count(*) FILTER (is_locked) AS locked FROM memories WHERE status = 'active'",
    MEMORIES,
)
def salience_stats(spark, sf_dir):
    s = F.col("salience")
    return memories(spark, sf_dir, text=False).filter("status = 'active'").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("mean"), F.round(F.min(s), 4).alias("low"), F.round(F.max(s), 4).alias("high"), _long(F.col("is_locked"), "locked")
    )


@query(
    "SELECT (SELECT count(*) FROM customer) AS personas, (SELECT count(*) FROM memories) AS events, (SELECT count(*) FROM memories WHERE status = 'archived') AS archived, "
    "(SELECT count(*) FROM memories WHERE is_locked) AS locked, (SELECT count(DISTINCT group_id) FROM memories) AS groups, (SELECT count(*) FROM impressions) AS impressions, "
    "(SELECT count(DISTINCT (group_id, floor(start_time / 86400))) FROM memories) AS summaries",
    MEMORIES, IMPRESSIONS,
)
def plugin_stats(spark, sf_dir):
    own = memories(spark, sf_dir, text=False).agg(
        F.count(F.lit(1)).alias("events"), _long(F.col("status") == "archived", "archived"), _long(F.col("is_locked"), "locked"), F.countDistinct("group_id").alias("groups"),
        F.countDistinct("group_id", F.floor(F.col("start_time") / 86400)).alias("summaries"),
    )
    people = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("personas"))
    edges = impressions(spark, sf_dir).agg(F.count(F.lit(1)).alias("impressions"))
    # single rows
    return own.crossJoin(people).crossJoin(edges).select("personas", "events", "archived", "locked", "groups", "impressions", "summaries")


@query(
    "SELECT l_suppkey AS uid, p_type AS tag, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, tag) <= 5"
)
def persona_top_tags(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag"))
    counts = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").groupBy(F.col("l_suppkey").alias("uid"), "tag").agg(F.count(F.lit(1)).alias("n"))
    return O.latest_per_group(counts, "uid", [F.col("n").desc(), "tag"], 5)


@query(
    "SELECT name, coalesce(n, 0) AS n FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT '') LEFT JOIN "
    "(SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1) USING (name) ORDER BY n DESC, name = '' DESC, name"
)
def bot_persona_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).union(orders.select("o_orderpriority")).union(spark.sql("SELECT ''")).distinct()
    counts = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.col("n").desc(), F.when(F.col("name") == "", 0).otherwise(1), "name")


@query(
    "SELECT event_id, group_id FROM memories QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY start_time DESC, event_id) <= greatest(1, 60 // (SELECT count(DISTINCT group_id) FROM memories)) ",
    MEMORIES,
)
def latest_per_group(spark, sf_dir):
    """A fair share of the newest memories of each group."""
    rows = memories(spark, sf_dir, text=False)
    share = max(1, 60 // max(1, rows.select("group_id").distinct().count()))
    return O.latest_per_group(rows, "group_id", [F.col("start_time").desc(), "event_id"], share).select("event_id", "group_id")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.col("ts").desc(), "event_id").offset(50).limit(25).select("event_id", "user_id", "ts")


@query(
    "SELECT group_id, featured, salience, recent FROM (SELECT group_id, arg_max(event_id, (salience, -event_id)) AS featured, max(salience) AS salience FROM memories GROUP BY group_id) JOIN "
    "(SELECT group_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) AS recent FROM (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY start_time DESC, event_id DESC) <= 3) GROUP BY group_id) USING (group_id)",
    MEMORIES,
)
def featured_argmax(spark, sf_dir):
    best = F.max(F.struct("salience", (-F.col("event_id")).alias("id"))).alias("b")
    rows = memories(spark, sf_dir, text=False)
    three = O.latest_per_group(rows, "group_id", [F.col("start_time").desc(), F.col("event_id").desc()], 3)
    recent = three.groupBy("group_id").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("r"))
    recent = recent.select("group_id", F.array_join(F.col("r").cast("array<string>"), ",").alias("recent"))
    return rows.groupBy("group_id").agg(best).join(recent, "group_id").select("group_id", (-F.col("b.id")).alias("featured"), "b.salience", "recent")


@query(
    """SELECT round(avg(n), 6) AS mean_participants, round(avg(tags), 6) AS mean_tags, max(n) AS most, round(avg(salience), 6) AS mean_salience,
  round((SELECT sum(n) FROM impressions) / count(*), 6)::DOUBLE AS citations
FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_returnflag) AS tags, least(1.0::DOUBLE, sum(l_quantity::BIGINT)::DOUBLE / 200) AS salience FROM lineitem GROUP BY 1)""",
    IMPRESSIONS,
)
def event_averages(spark, sf_dir):
    """Means over all events: who took part, tags, salience, and how often an edge cites one."""
    salience = F.least(F.lit(1.0), F.sum(F.col("l_quantity").cast("long")) / 200).alias("salience")
    per_event = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"), F.countDistinct("l_returnflag").alias("tags"), salience)
    means = per_event.agg(F.avg("n").alias("p"), F.avg("tags").alias("t"), F.max("n").alias("most"), F.avg("salience").alias("s"), F.count(F.lit(1)).alias("events"))
    cited = impressions(spark, sf_dir).agg(F.sum("n").alias("cited"))
    return means.crossJoin(cited).select(  # one row each
        F.round("p", 6).alias("mean_participants"), F.round("t", 6).alias("mean_tags"), "most", F.round("s", 6).alias("mean_salience"),
        F.round(F.col("cited") / F.col("events"), 6).alias("citations"),
    )


@query(
    """, phases AS (SELECT event_type AS phase, avg(value) / 1000 AS seconds FROM events WHERE value > 0 GROUP BY 1 HAVING avg(value) > 0)
SELECT phase, round(seconds, 8) AS seconds FROM phases UNION ALL SELECT 'total', round(sum(seconds), 8) FROM phases""",
    "one AS (SELECT 1)",
)
def perf_totals(spark, sf_dir):
    """Seconds of each phase without idle samples, and all together; phases that take none are left out."""
    phases = _events(spark, sf_dir).filter("value > 0").groupBy(F.col("event_type").alias("phase")).agg((F.avg("value") / 1000).alias("seconds")).filter("seconds > 0")
    total = phases.agg(F.lit("total").alias("phase"), F.sum("seconds").alias("seconds"))
    return phases.unionByName(total).select("phase", F.round("seconds", 8).alias("seconds"))


@query(
    "SELECT event_id, event_type, round(avg(value) OVER w, 8) AS recent_mean, last_value(value) OVER w AS latest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
)
def perf_phases(spark, sf_dir):
    """Mean and last value over the last fifty samples of each phase."""
    rows = O.numbered(_events(spark, sf_dir), "event_type", ["ts", "event_id"], F.to_date("ts"))
    found = O.rolling(rows, "event_type", "position", 50, 100_000, recent_mean=F.avg("value"), latest=F.last("value"))
    return found.select("event_id", "event_type", F.round("recent_mean", 8).alias("recent_mean"), "latest")


@query(
    "SELECT task, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(prompt + completion)::BIGINT AS tokens, round(sum(prompt + completion) / sum(sum(prompt + completion)) OVER (), 6)::DOUBLE AS share, round(sum(sum(prompt)) OVER () / sum(sum(prompt + completion)) OVER (), 6)::DOUBLE AS prompt_share "
    "FROM (SELECT 't' || conv_id % 5 AS task, CASE WHEN role = 'assistant' THEN 0 ELSE greatest(1, length(text) // 2) END AS prompt, CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 2) ELSE 0 END AS completion FROM conversations) GROUP BY task"
)
def token_usage(spark, sf_dir):
    """Tokens of prompts and of completions by task, the task's share of all, and the share of prompts in all."""
    cost = tokens(F.col("text")).cast("long")
    said = lambda own: F.sum(F.when((F.col("role") == "assistant") == F.lit(own), cost).otherwise(0))
    task = F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("task")
    per = table(spark, sf_dir, "conversations").groupBy(task).agg(F.count(F.lit(1)).alias("calls"), said(False).alias("prompt"), said(True).alias("completion"))
    per = per.withColumn("tokens", F.col("prompt") + F.col("completion"))
    every = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("prompt").alias("all_prompts"))  # one row
    shares = F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("share"), F.round(F.col("all_prompts") / F.col("all_tokens"), 6).alias("prompt_share")
    return per.crossJoin(every).select(*per.columns, *shares)


@query(
    "SELECT o_orderpriority AS group_id, count(*) AS events, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time, count(DISTINCT o_custkey) AS participants FROM orders GROUP BY 1"
)
def event_bounds(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("group_id")).agg(
        F.count(F.lit(1)).alias("events"), F.min("o_orderdate").alias("first_time"), F.max("o_orderdate").alias("last_time"), F.countDistinct("o_custkey").alias("participants")
    )


@query("SELECT a.group_id, b.event_id FROM memories a JOIN memories b ON a.group_id IS NOT DISTINCT FROM b.group_id WHERE a.event_id = 5", MEMORIES)
def axis_same_group(spark, sf_dir):
    rows = memories(spark, sf_dir, text=False)
    chosen = rows.filter("event_id = 5").select(F.col("group_id").alias("g"))
    return rows.join(F.broadcast(chosen), F.col("group_id").eqNullSafe(F.col("g"))).select("group_id", "event_id")
