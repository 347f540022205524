"""Queries of people and their traits: identities, profiles, members, updates of impressions from scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import circumplex as C
from tidemark.operators import lifecycle as L
from tidemark.operators import social as O
from tidemark.operators import windows
from tidemark.plans.registry import query
from tidemark.plans.social import _PROJECTED, _projected
from tidemark.sources.tables import IMPRESSIONS, MEMBERS, MEMORIES, impressions, members, memories, table

_KNOWN = "known AS (SELECT c_custkey AS uid, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS name FROM customer WHERE c_nationkey < 20)"


def _known(spark, sf_dir):
    """Some people have been seen, half of them with their number for a name."""
    name = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("uid"), name.alias("name"))


@query(
    "SELECT uid, coalesce(CASE WHEN regexp_full_match(k.name, '[0-9]+') AND s.name IS NOT NULL AND NOT regexp_full_match(s.name, '[0-9]+') THEN s.name ELSE k.name END, s.name) AS name, k.uid IS NULL AS minted "
    "FROM known k FULL JOIN (SELECT o_custkey AS uid, min_by('n' || o_orderkey, (o_orderdate, o_orderkey)) AS name FROM orders GROUP BY 1) s USING (uid)",
    _KNOWN,
)
def identity_mint(spark, sf_dir):
    """First sight makes a persona; a number for a name gives way to a name."""
    shown = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.min_by(shown, F.struct("o_orderdate", "o_orderkey")).alias("shown"))
    both = _known(spark, sf_dir).withColumn("old", F.lit(True)).join(seen, "uid", "full")
    number = lambda c: F.col(c).rlike("^[0-9]+$")
    better = number("name") & F.col("shown").isNotNull() & ~number("shown")
    return both.select("uid", F.when(better, F.col("shown")).otherwise(F.coalesce("name", "shown")).alias("name"), F.col("old").isNull().alias("minted"))


@query("SELECT c_custkey AS uid, c_name AS name, max(o_orderdate) AS last_active_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def persona_touch(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_active_at"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), "last_active_at")


@query(
    "SELECT platform, k, max_by(uid, late) AS uid FROM (SELECT c_mktsegment AS platform, c_nationkey AS k, c_custkey AS uid, 0 AS late FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) = 1 "
    "UNION ALL SELECT c_mktsegment, c_nationkey, c_custkey, 1 FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey DESC) = 1) GROUP BY ALL"
)
def bind_identity(spark, sf_dir):
    """A binding (platform, number) may be taken over by another person."""
    people = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("platform"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("uid"), "c_acctbal")
    keys = ["platform", "k"]
    old = L.latest(people, keys, [F.col("uid").asc()]).drop("c_acctbal")
    new = L.latest(people.filter("c_acctbal > 0"), keys, [F.col("uid").desc()]).drop("c_acctbal")
    return L.upsert(old, new, keys)


@query(
    "SELECT coalesce(g, '__private__') AS group_id, string_agg(uid::VARCHAR, ',' ORDER BY uid) AS members FROM (SELECT DISTINCT CASE WHEN event_type <> 'signup' THEN event_type END AS g, user_id AS uid FROM events) GROUP BY g"
)
def group_members(spark, sf_dir):
    """Members of each group, in order; private chats are one group."""
    group = F.coalesce(F.when(F.col("event_type") != "signup", F.col("event_type")), F.lit("__private__"))
    rows = table(spark, sf_dir, "events").select(group.alias("group_id"), F.col("user_id").alias("uid")).distinct()
    found = rows.groupBy("group_id").agg(F.array_sort(F.collect_list("uid")).alias("m"))
    return found.select("group_id", F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


_ORDERS = {"most": "n DESC, s_name", "fewest": "n, s_name", "a to z": "s_name, s_suppkey", "z to a": "s_name DESC, s_suppkey"}


@query(
    "WITH said AS (SELECT s_suppkey, s_name, n FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)) "
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{way}' AS way, s_suppkey AS uid, s_name AS name, row_number() OVER (ORDER BY {order}) AS place FROM said QUALIFY place <= 50)" for way, order in _ORDERS.items())
)
def member_sort(spark, sf_dir):
    """The first page of members in each of the four orders: by messages, most or fewest first, and by name, from either end."""
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "supplier").join(said, "s_suppkey").select("s_suppkey", "s_name", "n")
    name, n = F.col("s_name"), F.col("n")
    pages = []
    for way, order in {"most": [n.desc(), name], "fewest": [n, name], "a to z": [name, F.col("s_suppkey")], "z to a": [name.desc(), F.col("s_suppkey")]}.items():
        place = F.row_number().over(W.orderBy(*order)).cast("long")
        pages.append(rows.orderBy(*order).limit(50).select(F.lit(way).alias("way"), F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"), place.alias("place")))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query(
    """, counts AS (SELECT group_id, tag, count(*) AS n FROM (SELECT group_id, unnest([lang, status]) AS tag FROM memories) GROUP BY group_id, tag),
top AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, tag) <= 3)
SELECT group_id, string_agg(tag || ':' || n, ',' ORDER BY n DESC, tag) AS top_tags FROM top GROUP BY group_id""",
    MEMORIES,
)
def graph_top_tags(spark, sf_dir):
    """The most frequent tags over all nodes of each group's graph."""
    tags = memories(spark, sf_dir, text=False).select("group_id", F.explode(F.array("lang", "status")).alias("tag"))
    counts = tags.groupBy("group_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    n = F.row_number().over(W.partitionBy("group_id").orderBy(F.col("n").desc(), "tag"))
    top = counts.withColumn("k", n).filter("k <= 3").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("k", "tag", "n"))).alias("t"))
    return top.select("group_id", F.array_join(F.transform("t", lambda x: F.concat(x["tag"], F.lit(":"), x["n"].cast("string"))), ",").alias("top_tags"))


@query("SELECT c_custkey AS uid FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000")
def filter_personas(spark, sf_dir):
    """Name substring, any of some tags, and a range."""
    people = table(spark, sf_dir, "customer")
    return people.filter(F.contains(F.lower("c_name"), F.lit("1")) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000)).select(F.col("c_custkey").alias("uid"))


@query("SELECT DISTINCT group_id FROM memories WHERE group_id IN (SELECT group_id FROM memories WHERE lang = 'es')", MEMORIES)
def tag_matched_groups(spark, sf_dir):
    rows = memories(spark, sf_dir, text=False)
    return rows.select("group_id").distinct().join(rows.filter("lang = 'es'").select("group_id"), "group_id", "left_semi")


@query(
    "SELECT s_suppkey AS uid, round(CASE WHEN high = low THEN 17 ELSE 12 + 10 * (n - low)::DOUBLE / (high - low) END, 6)::DOUBLE AS radius FROM (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM "
    "(SELECT l_suppkey AS s_suppkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) WINDOW w AS (PARTITION BY s_nationkey))"
)
def node_radius(spark, sf_dir):
    """Radius of each member from its messages, between those of the quietest and the loudest of its group."""
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("s_nationkey")
    rows = said.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    rows = rows.select(F.col("s_suppkey").alias("uid"), "n", F.min("n").over(group).alias("low"), F.max("n").over(group).alias("high"))
    return rows.select("uid", F.round(O.radius(F.col("n"), F.col("low"), F.col("high")), 6).alias("radius"))


@query(
    "SELECT least(observer, subject) AS u, greatest(observer, subject) AS v, round(avg(benevolence), 6) AS benevolence, round(avg(power), 6) AS power FROM impressions WHERE scope = 'R' GROUP BY ALL",
    IMPRESSIONS,
)
def edge_combined_axes(spark, sf_dir):
    """Both directions of a pair are averaged; one alone stands for itself."""
    rows = impressions(spark, sf_dir).filter("scope = 'R'")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy(F.least("observer", "subject").alias("u"), F.greatest("observer", "subject").alias("v")).agg(mean("benevolence"), mean("power"))


@query(
    "SELECT observer, subject, scope FROM projected WHERE NOT (observer = 3 AND scope IN ('R')) AND confidence >= 0.3",
    IMPRESSIONS, _PROJECTED,
)
def delete_impression(spark, sf_dir):
    """Without one observer's impressions in a scope, and without weak ones."""
    return _projected(spark, sf_dir).filter("NOT (observer = 3 AND scope = 'R') AND confidence >= 0.3").select("observer", "subject", "scope")


@query(
    "SELECT s_suppkey AS uid, round(0.35 * new + 0.65 * old, 4) AS trait, round(0.35 * least(1, n / 5) + 0.65 * 0.5, 6)::DOUBLE AS confidence FROM (SELECT s_suppkey, (s_suppkey * 13 % 201 - 100) / 100.0::DOUBLE AS new, "
    "(s_suppkey * 29 % 201 - 100) / 100.0::DOUBLE AS old, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier)"
)
def persona_synthesis(spark, sf_dir):
    """Trait scores and confidence move towards a model's new ones."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    new, old = ((F.col("s_suppkey") * k % 201 - 100) / 100.0 for k in (13, 29))
    confidence = C.ema(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 5), F.lit(0.5), 0.35)
    return table(spark, sf_dir, "supplier").join(seen, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("uid"), F.round(C.ema(new, old, 0.35), 4).alias("trait"), F.round(confidence, 6).alias("confidence")
    )


@query(
    "SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM memories WHERE status = 'active' ORDER BY salience DESC, event_id LIMIT 20) THEN 40000000.0::DOUBLE ELSE start_time END AS last_accessed_at FROM memories",
    MEMORIES,
)
def touch_accessed(spark, sf_dir):
    """The time of the last access moves for the hits of a recall."""
    rows = memories(spark, sf_dir, text=False)
    hits = rows.filter("status = 'active'").orderBy(F.col("salience").desc(), "event_id").limit(20).select("event_id", F.lit(40_000_000.0).alias("now"))
    return rows.join(F.broadcast(hits), "event_id", "left").select("event_id", F.coalesce("now", "start_time").alias("last_accessed_at"))


@query(
    "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS participants, "
    "string_agg(substr(text, 1, 100), chr(10) ORDER BY turn, role, text) AS flow FROM conversations GROUP BY conv_id"
)
def event_build(spark, sf_dir):
    """An event from a window of messages: its bounds, who spoke, and previews in order."""
    rows = table(spark, sf_dir, "conversations")
    out = rows.groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"),
    )
    return out.select("conv_id", "first_turn", "last_turn", "participants", F.array_join(F.transform("t", lambda t: F.substring(t.text, 1, 100)), "\n").alias("flow"))


@query(
    "SELECT uid, count(*) AS met FROM members WHERE event_id IN (SELECT event_id FROM members WHERE uid = 5) AND uid <> 5 GROUP BY uid",
    MEMBERS,
)
def shared_with_member(spark, sf_dir):
    """Who met one member, and how often."""
    rows = members(spark, sf_dir)
    own = rows.filter("uid = 5").select("event_id")
    return rows.filter("uid <> 5").join(own, "event_id", "left_semi").groupBy("uid").agg(F.count(F.lit(1)).alias("met"))


@query(
    "SELECT event_id, event_type, salience FROM memories WHERE is_locked OR group_id IS NULL OR lang = 'de' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY salience DESC, event_id) <= 5",
    MEMORIES,
)
def recall_persona_postfilter(spark, sf_dir):
    """A filter behind the recall, then the slice of each tier."""
    rows = memories(spark, sf_dir, text=False).filter("is_locked OR group_id IS NULL OR lang = 'de'")
    return windows.latest_per_group(rows, "event_type", [F.col("salience").desc(), "event_id"], 5).select("event_id", "event_type", "salience")
