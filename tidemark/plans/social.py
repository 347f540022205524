"""Queries of the social graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import circumplex as C
from tidemark.operators import clusters, scope
from tidemark.operators import social as O
from tidemark.plans.registry import query
from tidemark.sources.tables import IMPRESSIONS, MEMBERS, MEMORIES, impressions, members, memories, table

_OCTANT = (
    "CASE WHEN abs(benevolence) < 1e-9 AND abs(power) < 1e-9 THEN 0 ELSE "
    "(round_even(((degrees(atan2(power, benevolence)) + 360) % 360) / 45, 0)::INTEGER % 8) END"
)
_LABELS = "['affinity', 'active', 'dominant', 'arrogant', 'cold', 'withdrawn', 'submissive', 'deferential']"
_PROJECTED = f"""angles AS (SELECT *, {_OCTANT} AS o, (degrees(atan2(power, benevolence)) + 360) % 360 AS a FROM impressions),
projected AS (SELECT *, {_LABELS}[o + 1] AS orientation, least(1.0, sqrt(benevolence ** 2 + power ** 2) / sqrt(2.0::DOUBLE)) AS intensity,
  CASE WHEN sqrt(benevolence ** 2 + power ** 2) < 1e-6 THEN 0.5 ELSE greatest(0.0, 1 - least(abs(a - 45 * o), 360 - abs(a - 45 * o)) / 22.5) END AS fit FROM angles)"""


def _projected(spark, sf_dir):
    return impressions(spark, sf_dir).select("*", *O.derived(F.col("benevolence"), F.col("power")))


@query(
    "SELECT observer, subject, scope, orientation, round(intensity, 6)::DOUBLE AS intensity, round(fit, 6)::DOUBLE AS fit FROM projected",
    IMPRESSIONS, _PROJECTED,
)
def circumplex_project(spark, sf_dir):
    return _projected(spark, sf_dir).select(
        "observer", "subject", "scope", "orientation", F.round("intensity", 6).alias("intensity"), F.round("fit", 6).alias("fit")
    )


@query("SELECT scope, orientation, count(*) AS n FROM projected GROUP BY ALL", IMPRESSIONS, _PROJECTED)
def octant_distribution(spark, sf_dir):
    return _projected(spark, sf_dir).groupBy("scope", "orientation").agg(F.count(F.lit(1)).alias("n"))


_MOOD = "mood AS (SELECT scope || subject % 25 AS scope, sum(round(100 * benevolence)::BIGINT)::DOUBLE / (100 * count(*)) AS benevolence, sum(round(100 * power)::BIGINT)::DOUBLE / (100 * count(*)) AS power, count(*) AS n FROM impressions WHERE confidence >= 0.3 GROUP BY 1 HAVING count(*) >= 2 OR count(DISTINCT subject) = 1)"


@query(
    f"SELECT scope, round(benevolence, 6) AS benevolence, round(power, 6) AS power, n, {_LABELS}[{_OCTANT} + 1] AS orientation FROM mood",
    IMPRESSIONS, _MOOD,
)
def mood_centroid(spark, sf_dir):
    """Where a group stands on the whole: at least two sure impressions, or one if it has a single member."""
    sure = impressions(spark, sf_dir).filter("confidence >= 0.3")
    group = F.concat("scope", (F.col("subject") % 25).cast("string")).alias("scope")
    # values are whole hundredths, whose sums don't depend on their order
    mean = lambda c: F.sum(F.round(100 * F.col(c)).cast("long")).cast("double") / (100 * F.count(F.lit(1)))
    mood = sure.groupBy(group).agg(mean("benevolence").alias("b"), mean("power").alias("p"), F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("people")).filter("n >= 2 OR people = 1")
    label = C.octant(F.col("b"), F.col("p"))
    return mood.select("scope", F.round("b", 6).alias("benevolence"), F.round("p", 6).alias("power"), "n", label.alias("orientation"))


@query(
    "SELECT orientation, string_agg(subject::VARCHAR, ',' ORDER BY subject) AS subjects FROM (SELECT DISTINCT orientation, subject FROM projected WHERE scope = 'R') GROUP BY orientation",
    IMPRESSIONS, _PROJECTED,
)
def names_by_orientation(spark, sf_dir):
    rows = _projected(spark, sf_dir).filter("scope = 'R'").groupBy("orientation").agg(F.array_sort(F.collect_set("subject")).alias("s"))
    return rows.select("orientation", F.array_join(F.col("s").cast("array<string>"), ",").alias("subjects"))


@query(
    "SELECT b.observer, b.subject, round(coalesce(0.4 * n.benevolence + 0.6 * o.benevolence, n.benevolence, o.benevolence), 6)::DOUBLE + 0.0 AS benevolence, "
    "round(coalesce(0.4 * n.power + 0.6 * o.power, n.power, o.power), 6)::DOUBLE + 0.0 AS power FROM (SELECT observer, subject FROM impressions WHERE scope IN ('R', 'A') GROUP BY ALL) b "
    "LEFT JOIN (SELECT * FROM impressions WHERE scope = 'R') o USING (observer, subject) LEFT JOIN (SELECT * FROM impressions WHERE scope = 'A') n USING (observer, subject)",
    IMPRESSIONS,
)
def impression_ema(spark, sf_dir):
    """The edges of one scope, moved towards those of another."""
    own = impressions(spark, sf_dir)
    out = O.smooth(own.filter("scope = 'R'"), own.filter("scope = 'A'").select("observer", "subject", "benevolence", "power"), ["observer", "subject"], ["benevolence", "power"])
    # adding zero turns -0.0 into 0.0
    return out.select("observer", "subject", (F.round("benevolence", 6) + 0.0).alias("benevolence"), (F.round("power", 6) + 0.0).alias("power"))


@query(
    "SELECT p_partkey AS uid, round(greatest(-1, least(1, 0.70 * a + 0.35 * e - 0.20 * n)), 6)::DOUBLE AS benevolence, "
    "round(greatest(-1, least(1, 0.70 * e + 0.35 * c - 0.15 * n)), 6)::DOUBLE AS power FROM (SELECT p_partkey, (p_size % 21 - 10) / 10.0::DOUBLE AS a, "
    "(p_size * 3 % 21 - 10) / 10.0::DOUBLE AS e, (p_size * 5 % 21 - 10) / 10.0::DOUBLE AS n, (p_partkey % 21 - 10) / 10.0::DOUBLE AS c FROM part)"
)
def bigfive_rotation(spark, sf_dir):
    trait = lambda x: (F.expr(x) % 21 - 10) / 10.0
    b, p = C.rotate(F.lit(0.0), trait("p_partkey"), trait("p_size * 3"), trait("p_size"), trait("p_size * 5"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.round(b, 6).alias("benevolence"), F.round(p, 6).alias("power"))


_SHARED = "shared AS (SELECT a.uid AS observer, b.uid AS subject, count(*) AS shared FROM members a JOIN members b ON a.event_id = b.event_id AND a.uid <> b.uid GROUP BY ALL)"


@query("SELECT observer, subject, shared FROM shared WHERE observer < subject", MEMBERS, _SHARED)
def pair_cooccurrence(spark, sf_dir):
    return O.shared_events(members(spark, sf_dir), directed=False)


@query(
    "SELECT observer, subject, count(*) AS shared, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) AS evidence FROM (SELECT a.uid AS observer, b.uid AS subject, a.event_id "
    "FROM members a JOIN members b ON a.event_id = b.event_id AND a.uid < b.uid QUALIFY row_number() OVER (PARTITION BY a.uid, b.uid ORDER BY a.event_id DESC) <= 100) GROUP BY ALL",
    MEMBERS,
)
def evidence_intersection(spark, sf_dir):
    """The newest hundred shared events of every pair."""
    newest = O.newest_shared(members(spark, sf_dir), 100, directed=False).groupBy("observer", "subject").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("e"))
    return newest.select("observer", "subject", F.size("e").cast("long").alias("shared"), F.array_join(F.col("e").cast("array<string>"), ",").alias("evidence"))


@query(
    "SELECT s_suppkey AS uid, s_name AS name, coalesce(messages, 0) AS messages, coalesce(events, 0) AS events FROM supplier LEFT JOIN "
    "(SELECT l_suppkey AS s_suppkey, count(*) AS messages, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY ALL) USING (s_suppkey)"
)
def graph_nodes(spark, sf_dir):
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("l_orderkey").alias("events")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "supplier").join(said, "s_suppkey", "left").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"), zero("messages"), zero("events"))


@query(
    "SELECT observer || '--' || subject || '--' || scope || '--' || CASE WHEN observer % 3 > 0 THEN 'p' || (observer % 3) ELSE 'legacy' END AS edge_id, orientation, round(intensity, 3)::DOUBLE AS intensity, n AS messages FROM projected",
    IMPRESSIONS, _PROJECTED,
)
def graph_edges(spark, sf_dir):
    persona = F.when(F.col("observer") % 3 > 0, F.concat(F.lit("p"), (F.col("observer") % 3).cast("string")))
    return _projected(spark, sf_dir).select(
        F.concat_ws("--", F.col("observer").cast("string"), F.col("subject").cast("string"), "scope", F.coalesce(persona, F.lit("legacy"))).alias("edge_id"),
        "orientation", F.round("intensity", 3).alias("intensity"), F.col("n").alias("messages"),
    )


_MUTUAL = """mutual AS (SELECT u, v, forward IS NOT NULL AND backward IS NOT NULL AS mutual,
  CASE WHEN forward IS NOT NULL AND backward IS NOT NULL THEN (forward + backward) * 1.2 ELSE coalesce(forward, backward) END AS affinity, messages
  FROM (SELECT least(observer, subject) AS u, greatest(observer, subject) AS v, max(intensity) FILTER (observer < subject) AS forward,
    max(intensity) FILTER (observer > subject) AS backward, sum(n)::BIGINT AS messages FROM projected WHERE scope = 'R' GROUP BY ALL))"""


def _pairs(spark, sf_dir):
    return O.mutual(_projected(spark, sf_dir).filter("scope = 'R'"))


@query("SELECT u, v, mutual, round(affinity, 6)::DOUBLE AS affinity, messages FROM mutual", IMPRESSIONS, _PROJECTED, _MUTUAL)
def edge_pairs_mutual(spark, sf_dir):
    return _pairs(spark, sf_dir).select("u", "v", "mutual", F.round("affinity", 6).alias("affinity"), "messages")


_EDGES = "edges AS (SELECT parent AS u, event_id AS v FROM memories WHERE parent IS NOT NULL)"


def _thread_edges(spark, sf_dir):
    """Memories and what they inherit from: a graph with many parts, the threads."""
    return memories(spark, sf_dir, text=False).filter("parent IS NOT NULL").select(F.col("parent").alias("u"), F.col("event_id").alias("v"))


@query("SELECT node, count(DISTINCT other) AS degree FROM (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges) GROUP BY node", MEMORIES, _EDGES)
def degree(spark, sf_dir):
    return O.degree(_thread_edges(spark, sf_dir))


@query("SELECT DISTINCT other AS neighbour FROM (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges) WHERE node = 8", MEMORIES, _EDGES)
def ego_network(spark, sf_dir):
    return O.ego(_thread_edges(spark, sf_dir), 8)


@query(
    """, both_ AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS root FROM both_ UNION SELECT e.v, r.root FROM reach r JOIN both_ e ON e.u = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY node""",
    MEMORIES, _EDGES,
)
def components(spark, sf_dir):
    return clusters.components(_thread_edges(spark, sf_dir))


@query("SELECT event_id FROM memories WHERE event_id NOT IN (SELECT u FROM edges UNION SELECT v FROM edges)", MEMORIES, _EDGES)
def isolated_nodes(spark, sf_dir):
    edges = _thread_edges(spark, sf_dir)
    ends = edges.select(F.col("u").alias("event_id")).union(edges.select("v"))
    return memories(spark, sf_dir, text=False).select("event_id").join(ends, "event_id", "left_anti")


@query(
    "SELECT o_orderpriority AS group_id, count(DISTINCT l_suppkey) AS members, count(DISTINCT o_orderkey) AS events, max(o_orderdate)::DATE AS last_active FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"
)
def group_cards(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(members(spark, sf_dir).withColumnRenamed("event_id", "o_orderkey"), "o_orderkey")
    return rows.groupBy(F.col("o_orderpriority").alias("group_id")).agg(
        F.countDistinct("uid").alias("members"), F.countDistinct("o_orderkey").alias("events"), F.to_date(F.max("o_orderdate")).alias("last_active")
    )


@query(
    "SELECT observer, subject, endpoint_msg_count FROM (SELECT e.observer, e.subject, count(*) AS endpoint_msg_count FROM (SELECT DISTINCT observer, subject FROM impressions WHERE observer < subject) e "
    "JOIN (SELECT l_suppkey % 40 AS uid FROM lineitem) m ON m.uid IN (e.observer, e.subject) GROUP BY ALL)",
    IMPRESSIONS,
)
def edge_message_counts(spark, sf_dir):
    """Messages by either end of an edge: counted per person first, so the join is with one row each."""
    edges = impressions(spark, sf_dir).filter("observer < subject").select("observer", "subject").distinct()
    said = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda end: said.select(F.col("uid").alias(end), F.col("n").alias(f"n_{end}"))
    joined = edges.join(one("observer"), "observer", "left").join(one("subject"), "subject", "left")
    total = F.coalesce("n_observer", F.lit(0)) + F.coalesce("n_subject", F.lit(0))
    return joined.select("observer", "subject", total.alias("endpoint_msg_count")).filter("endpoint_msg_count > 0")


@query(
    "SELECT uid, round(300 + 200 * cos(2 * pi() * i / n - pi() / 2), 4) AS x, round(300 + 200 * sin(2 * pi() * i / n - pi() / 2), 4) AS y FROM "
    "(SELECT s_suppkey AS uid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"
)
def graph_circular_layout(spark, sf_dir):
    """Places on a circle, one circle a group."""
    group = W.partitionBy("s_nationkey")
    shown = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("uid"), (F.row_number().over(group.orderBy("s_suppkey")) - 1).alias("i"), F.count(F.lit(1)).over(group).alias("n")
    )
    at = 2 * F.pi() * F.col("i") / F.col("n") - F.pi() / 2
    return shown.select("uid", F.round(300 + 200 * F.cos(at), 4).alias("x"), F.round(300 + 200 * F.sin(at), 4).alias("y"))


@query(
    "SELECT c_custkey, persona FROM (SELECT c_custkey, CASE WHEN c_nationkey % 5 > 0 THEN c_mktsegment END AS persona FROM customer) WHERE persona = 'BUILDING' OR persona IS NULL"
)
def filter_persona_scope(spark, sf_dir):
    """A persona's rows and those from before there were personas."""
    persona = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_mktsegment")).alias("persona")
    return table(spark, sf_dir, "customer").select("c_custkey", persona).filter(scope.persona(F.col("persona"), "BUILDING"))


@query(
    "SELECT o_custkey AS uid, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_custkey % 10), 6) AS share FROM orders GROUP BY o_custkey"
)
def msg_share(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.col("uid") % 10))
    return counts.select("uid", "n", F.round(share, 6).alias("share"))
