"""Queries of filters, projections and text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import scope
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES, memories, table


@query("SELECT event_id, group_id, status FROM memories WHERE event_id = 42", MEMORIES)
def scan_event_pk(spark, sf_dir):
    return memories(spark, sf_dir, text=False).filter("event_id = 42").select("event_id", "group_id", "status")


@query("SELECT event_id, start_time FROM memories WHERE status = 'active' ORDER BY start_time DESC, event_id LIMIT 100", MEMORIES)
def scan_list_all(spark, sf_dir):
    rows = memories(spark, sf_dir, text=False).filter("status = 'active'")
    return rows.orderBy(F.col("start_time").desc(), "event_id").limit(100).select("event_id", "start_time")


@query("SELECT user_id, event_id FROM (SELECT *, CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS g FROM events) WHERE g IS NULL")
def filter_nullsafe_group(spark, sf_dir):
    g = F.when(F.col("user_id") % 4 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").filter(scope.in_group(g, None)).select("user_id", "event_id")


@query("SELECT event_id FROM memories WHERE event_type <> 'narrative' AND salience < 0.3 AND NOT is_locked AND status = 'active'", MEMORIES)
def filter_low_salience(spark, sf_dir):
    rows = memories(spark, sf_dir, text=False).filter("event_type <> 'narrative' AND salience < 0.3 AND NOT is_locked AND status = 'active'")
    return rows.select("event_id")


@query("SELECT event_id, group_id FROM memories WHERE contains(lower(text), 'scum') OR contains(lower(group_id), 'scum') OR contains(lower(lang), 'scum')", MEMORIES)
def filter_search_multi(spark, sf_dir):
    hit = scope.any_contains([F.col("text"), F.col("group_id"), F.col("lang")], "Scum")
    return memories(spark, sf_dir).filter(hit).select("event_id", "group_id")


@query(
    "SELECT event_id, 'both' AS range FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-13' UNION ALL SELECT event_id, 'from' FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-21' "
    "UNION ALL SELECT event_id, 'none' FROM events"
)
def filter_date_range(spark, sf_dir):
    """From a day to the end of another, both ends included; a day alone is that day; without one all rows pass."""
    rows = table(spark, sf_dir, "events")
    ranges = {"both": ("2024-01-10", "2024-01-12"), "from": ("2024-01-20", None), "none": (None, None)}
    parts = [rows.filter(scope.in_days(F.col("ts"), *r)).select("event_id", F.lit(name).alias("range")) for name, r in ranges.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "SELECT event_id, 'all' AS asked FROM memories WHERE salience >= 0.9 UNION ALL SELECT event_id, 'src3' FROM memories WHERE salience >= 0.9 AND group_id = 'src3'",
    MEMORIES,
)
def filter_optional_param(spark, sf_dir):
    """A parameter that isn't given filters nothing."""
    rows = memories(spark, sf_dir, text=False).filter("salience >= 0.9")
    asked = lambda group: rows.filter(scope.optional(F.col("group_id"), group)).select("event_id", F.lit(group or "all").alias("asked"))
    return asked(None).unionByName(asked("src3"))


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src3'])")
def filter_tag_any(spark, sf_dir):
    tags = F.array("lang", "source")
    return table(spark, sf_dir, "documents").filter(F.arrays_overlap(tags, F.array(F.lit("de"), F.lit("src3")))).select("doc_id")


@query("SELECT event_id FROM events WHERE coalesce(CASE WHEN user_id % 4 <> 0 THEN event_type END, '__pvt__') NOT IN ('click', '__pvt__')")
def filter_not_in_set(spark, sf_dir):
    g = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.col("event_type")), F.lit("__pvt__"))
    return table(spark, sf_dir, "events").filter(~g.isin("click", "__pvt__")).select("event_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING array_has(list(DISTINCT role), 'system')")
def filter_array_contains(spark, sf_dir):
    """Conversations that have a role among their participants."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("participants"))
    return rows.filter(F.array_contains("participants", "system")).select("conv_id")


@query(
    "SELECT doc_id, tag FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '123456' WHEN 1 THEN '' WHEN 2 THEN '0f8fad5b-d9cb-469f-a165-70867728950e' WHEN 3 THEN source ELSE source || repeat('x', 40) END AS tag FROM documents) "
    "WHERE length(trim(tag)) BETWEEN 1 AND 30 AND NOT regexp_full_match(trim(tag), '[0-9]{5,}') AND NOT regexp_full_match(trim(tag), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')"
)
def filter_valid_tag(spark, sf_dir):
    n = F.col("doc_id") % 5
    tag = (
        F.when(n == 0, "123456").when(n == 1, "").when(n == 2, "0f8fad5b-d9cb-469f-a165-70867728950e").when(n == 3, F.col("source"))
        .otherwise(F.concat("source", F.lit("x" * 40)))
    )
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag")).filter(text.is_tag(F.col("tag")))


@query(
    """SELECT conv_id, turn, n < 3 OR (n > 5 AND most > 0.7 * n) AS noisy, turn % 2 = 0 AS padded FROM (SELECT conv_id, turn, length(t) AS n,
  coalesce(list_max(list_transform(list_distinct(string_split(t, '')), lambda s: len(list_filter(string_split(t, ''), lambda x: x = s)))), 0) AS most
  FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(said, '^\\s+', ''), '\\s+$', '') AS t FROM (
    SELECT conv_id, turn, text AS said FROM conversations WHERE turn % 2 = 1
    UNION ALL SELECT conv_id, turn, chr(10) || repeat(substr(text, 1, 1), 9) || substr(text, 1, turn % 7) || chr(10) || chr(9) FROM conversations WHERE turn % 2 = 0)))"""
)
def noise_filter(spark, sf_dir):
    """Whole turns, and every second one as a run of one letter with a few more, in white space."""
    run = F.concat(F.lit("\n"), F.repeat(F.substring("text", 1, 1), 9), F.col("text").substr(F.lit(1), (F.col("turn") % 7).cast("int")), F.lit("\n\t"))
    padded = F.col("turn") % 2 == 0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", padded.alias("padded"), F.when(padded, run).otherwise(F.col("text")).alias("said"))
    return rows.select("conv_id", "turn", text.is_noise(F.col("said")).alias("noisy"), "padded")


@query(
    "SELECT conv_id, turn, trim(regexp_replace(regexp_replace('[CQ:reply,id=1]@x(123456) ' || chr(10) || text || ' [图片]', '\\[CQ:[^\\]]*\\]|\\([0-9]{5,}\\)', '', 'g'), '\\s+', ' ', 'g')) AS said FROM conversations"
)
def normalize_text(spark, sf_dir):
    raw = F.concat(F.lit("[CQ:reply,id=1]@x(123456) \n"), F.col("text"), F.lit(" [CQ:image,file=a.png]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_message(raw).alias("said"))


@query("SELECT k, count(*) AS n FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY k")
def json_extract_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, round_even(salience, 3)::DOUBLE AS salience, CASE WHEN event_id % 5 > 0 THEN text ELSE substr(event_id::VARCHAR, 1, 8) END AS content, strftime(make_timestamp((start_time * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS start FROM memories",
    MEMORIES,
)
def project_event_dict(spark, sf_dir):
    # seconds to a UTC text whatever the session's time zone is
    # without a topic the first characters of the id stand for it
    topic = F.when(F.col("event_id") % 5 > 0, F.col("text")).otherwise("")
    content = F.coalesce(F.nullif(topic, F.lit("")), F.substring(F.col("event_id").cast("string"), 1, 8))
    start = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(start_time as decimal(18, 6)))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return memories(spark, sf_dir).select("event_id", F.bround("salience", 3).alias("salience"), content.alias("content"), start.alias("start"))


@query(
    "SELECT event_id, salience_ok, start_ok FROM (SELECT event_id, salience BETWEEN 0 AND 1 AS salience_ok, start_time <= 1000000 AS start_ok FROM memories) WHERE NOT (salience_ok AND start_ok)",
    MEMORIES,
)
def filter_range_valid(spark, sf_dir):
    """Rows that break a rule, with the rules told apart."""
    rows = memories(spark, sf_dir, text=False).select(
        "event_id", F.col("salience").between(0, 1).alias("salience_ok"), (F.col("start_time") <= 1_000_000).alias("start_ok")
    )
    return rows.filter("NOT (salience_ok AND start_ok)")


@query(
    "SELECT o_orderkey, c_custkey AS uid, coalesce(c_name, o_custkey::VARCHAR) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 10"
)
def lookup_identity(spark, sf_dir):
    """Messages to people; who is unknown keeps the id as a name."""
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("uid"), "c_name")
    rows = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("uid"), "left")
    return rows.select("o_orderkey", "uid", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("name"))


@query("SELECT o_custkey AS uid FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def intersect_event_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    of = lambda p: rows.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("uid"))
    return of("1-URGENT").intersect(of("5-LOW"))


@query("SELECT c_custkey AS uid FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_uncovered(spark, sf_dir):
    """People whom no urgent order covers."""
    covered = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")).subtract(covered)


@query(
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY list_no, n) AS place FROM (
  SELECT source, doc_id, list_no, n FROM (
    SELECT source, doc_id, 0 AS list_no, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents QUALIFY n <= 4
    UNION ALL SELECT source, doc_id, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents QUALIFY n <= 4)
  QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY list_no) = 1)"""
)
def union_ranked_dedup(spark, sf_dir):
    """The four longest and the four newest documents of each source, one list behind the other; the first place of a document wins."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    ranked = lambda k, *order: docs.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(*order))).filter("n <= 4").withColumn("list_no", F.lit(k))
    both = ranked(0, F.col("n_chars").desc(), "doc_id").unionByName(ranked(1, F.col("doc_id").desc()))
    first = both.groupBy("source", "doc_id").agg(F.min(F.struct("list_no", "n")).alias("at"))
    place = F.row_number().over(W.partitionBy("source").orderBy("at.list_no", "at.n"))
    return first.select("source", "doc_id", place.cast("long").alias("place"))


@query(
    "SELECT uid, string_agg(platform || ':' || k, ',' ORDER BY platform, k) AS bindings FROM (SELECT c_nationkey AS uid, c_mktsegment AS platform, max(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY uid"
)
def identity_bindings(spark, sf_dir):
    """The bindings of each person as one text."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("uid"), F.col("c_mktsegment").alias("platform")).agg(F.max("c_custkey").alias("k"))
    nested = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("platform", "k"))).alias("b"))
    return nested.select("uid", F.array_join(F.transform("b", lambda b: F.concat_ws(":", b.platform, b.k.cast("string"))), ",").alias("bindings"))
