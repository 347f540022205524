"""Queries that write the social graph: orientation from new events, a scope from what was shared, derived fields, group cards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import circumplex as C
from tidemark.operators import lifecycle as L
from tidemark.operators import social as O
from tidemark.operators import windows
from tidemark.plans.registry import query
from tidemark.plans.social import _LABELS, _OCTANT, _PROJECTED, _projected
from tidemark.sources.tables import IMPRESSIONS, dealt, impressions, table

ALPHA, DEBOUNCE, THRESHOLD, EVIDENCE = 0.4, 1000, 3, 100

#: Who said how much in which event of which scope; people are those of the impressions.
_SAID = """said AS (SELECT l_orderkey AS event_id, l_suppkey % 40 AS uid, count(*) AS n FROM lineitem GROUP BY ALL),
scopes AS (SELECT l_orderkey AS event_id, min(l_returnflag) AS scope FROM lineitem GROUP BY ALL)"""


def said(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") % 40).alias("uid"), "l_returnflag")
    scopes = line.groupBy("event_id").agg(F.min("l_returnflag").alias("scope"))
    return dealt(line.select("event_id", "uid"), "event_id", "uid").groupBy("event_id", "uid").agg(F.count(F.lit(1)).alias("n")), scopes


def _shared(spark, sf_dir):
    """observer, subject, scope, shared: events of the scope in which both took part."""
    rows, scopes = said(spark, sf_dir)
    met = O.pairs(rows.select("event_id", "uid")).join(scopes, "event_id")
    return met.groupBy("observer", "subject", "scope").agg(F.count(F.lit(1)).alias("shared"))


_SHARED = "shared AS (SELECT a.uid AS observer, b.uid AS subject, scope, count(*) AS shared FROM said a JOIN said b ON a.event_id = b.event_id AND a.uid <> b.uid JOIN scopes s ON s.event_id = a.event_id GROUP BY ALL)"
_T = "((uid * {k} % 21 - 10) / 10.0::DOUBLE)"
_FIELDS = f"""{_LABELS}[{_OCTANT} + 1] AS orientation, least(1.0, sqrt(benevolence ** 2 + power ** 2) / sqrt(2.0::DOUBLE)) AS intensity,
  CASE WHEN sqrt(benevolence ** 2 + power ** 2) < 1e-6 THEN 0.5 ELSE greatest(0.0, 1 - least(abs((degrees(atan2(power, benevolence)) + 360) % 360 - 45 * {_OCTANT}),
    360 - abs((degrees(atan2(power, benevolence)) + 360) % 360 - 45 * {_OCTANT})) / 22.5) END AS fit"""


@query(
    f""", traits AS (SELECT uid, uid % 4 = 0 AS none, greatest(-1, least(1, 0.70 * {_T.format(k=13)} + 0.35 * {_T.format(k=7)} - 0.20 * {_T.format(k=3)})) AS b,
  greatest(-1, least(1, 0.70 * {_T.format(k=7)} + 0.35 * {_T.format(k=5)} - 0.15 * {_T.format(k=3)})) AS p FROM (SELECT DISTINCT uid FROM said)),
fresh AS (SELECT a.event_id, a.uid AS observer, c.uid AS subject, scope, none, (a.event_id % 100) / 100.0::DOUBLE AS salience,
    a.n / (SELECT sum(n) FROM said t WHERE t.event_id = a.event_id) AS weight, b, p
  FROM said a JOIN said c ON a.event_id = c.event_id AND a.uid <> c.uid JOIN scopes s ON s.event_id = a.event_id JOIN traits t ON t.uid = a.uid WHERE a.event_id % 50 = 0),
by_rule AS (SELECT f.observer, f.subject, f.scope, min_by(salience, event_id) AS salience, min(event_id) AS event_id FROM fresh f LEFT JOIN impressions i
    ON (i.observer, i.subject, i.scope) = (f.observer, f.subject, f.scope) AND i.last_event > (SELECT max(event_id) FROM said) - 1000 WHERE none AND i.observer IS NULL GROUP BY ALL),
signals AS (SELECT * FROM (
    SELECT observer, subject, scope, event_id, b * salience * weight AS benevolence, p * salience * weight AS power FROM fresh WHERE NOT none
    UNION ALL SELECT r.observer, r.subject, r.scope, event_id, CASE WHEN shared >= 10 THEN least(1, 0.3 + 0.4 * salience) ELSE least(1, 0.1 + 0.3 * salience) END,
      CASE WHEN shared >= 10 THEN 0.2 ELSE 0 END FROM by_rule r JOIN shared s ON (s.observer, s.subject, s.scope) = (r.observer, r.subject, r.scope) WHERE shared >= 3)
  WHERE benevolence <> 0 OR power <> 0),
told AS (SELECT *, {_FIELDS}, row_number() OVER (PARTITION BY observer, subject, scope ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY observer, subject, scope) AS m FROM signals),
folded AS (SELECT observer, subject, scope, max(m) AS m, max(orientation) FILTER (r = 1) AS orientation,
    sum(0.4 * 0.6 ** (r - 1) * benevolence) AS b1, sum(CASE WHEN r = m THEN 0.6 ** (r - 1) ELSE 0.4 * 0.6 ** (r - 1) END * benevolence) AS b0,
    sum(0.4 * 0.6 ** (r - 1) * power) AS p1, sum(CASE WHEN r = m THEN 0.6 ** (r - 1) ELSE 0.4 * 0.6 ** (r - 1) END * power) AS p0,
    sum(0.4 * 0.6 ** (r - 1) * intensity) AS i1, sum(CASE WHEN r = m THEN 0.6 ** (r - 1) ELSE 0.4 * 0.6 ** (r - 1) END * intensity) AS i0,
    sum(0.4 * 0.6 ** (r - 1) * fit) AS f1, sum(CASE WHEN r = m THEN 0.6 ** (r - 1) ELSE 0.4 * 0.6 ** (r - 1) END * fit) AS f0 FROM told GROUP BY ALL)
SELECT f.observer, f.subject, f.scope, f.orientation, round(coalesce(0.6 ** m * e.benevolence + b1, b0) + 1e-9, 5) + 0.0 AS benevolence, round(coalesce(0.6 ** m * e.power + p1, p0) + 1e-9, 5) + 0.0 AS power,
  round(coalesce(0.6 ** m * e.intensity + i1, i0) + 1e-9, 5)::DOUBLE AS intensity, round(coalesce(0.6 ** m * e.confidence + f1, f0) + 1e-9, 5)::DOUBLE AS confidence,
  least(100, m + CASE WHEN e.observer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM signals s WHERE (s.observer, s.subject, s.scope, s.event_id) = (f.observer, f.subject, f.scope, e.last_event)) THEN 1 ELSE 0 END)::BIGINT AS evidence
FROM folded f LEFT JOIN projected e ON (e.observer, e.subject, e.scope) = (f.observer, f.subject, f.scope)""",
    IMPRESSIONS, _PROJECTED, _SAID, _SHARED,
)
def orientation_update(spark, sf_dir):
    """What new events (every fiftieth) do to the edges of a scope, one event after the other.

    An observer with trait scores gives a signal from them, by the event's salience and the observer's share of its
    messages. One without has the rule of shared events, if the edge wasn't reinforced lately and enough was shared.
    Existing edges move by a fixed share towards each signal, which has a closed form; new ones begin with the first.
    """
    rows, scopes = said(spark, sf_dir)
    uid = F.col("uid")
    trait = lambda k: (uid * k % 21 - 10) / 10.0
    b, p = C.rotate(F.lit(0.0), trait(5), trait(7), trait(13), trait(3))
    new = rows.filter("event_id % 50 = 0")
    share = F.col("n") / F.sum("n").over(W.partitionBy("event_id"))
    observers = new.select("event_id", uid.alias("observer"), (uid % 4 == 0).alias("none"), share.alias("weight"), b.alias("b"), p.alias("p"))
    met = observers.join(new.select("event_id", uid.alias("subject")), "event_id").filter("observer <> subject").join(scopes, "event_id")
    salience = (F.col("event_id") % 100) / 100.0
    keys = ["observer", "subject", "scope"]
    old = _projected(spark, sf_dir)
    by_traits = met.filter("NOT none").select(*keys, "event_id", *((F.col(x) * salience * F.col("weight")).alias(n) for x, n in (("b", "benevolence"), ("p", "power"))))
    now = F.broadcast(rows.agg(F.max("event_id").alias("now")))  # one row
    lately = old.crossJoin(now).filter(F.col("last_event") > F.col("now") - DEBOUNCE).select(*keys)
    first = L.without(met.filter("none"), lately, keys).groupBy(*keys).agg(F.min_by(salience, "event_id").alias("salience"), F.min("event_id").alias("event_id"))
    by_rule = first.join(_shared(spark, sf_dir).filter(F.col("shared") >= THRESHOLD), keys)
    hb, hp = C.heuristic(F.col("shared"), F.col("salience"))
    signals = by_traits.unionByName(by_rule.select(*keys, "event_id", hb.alias("benevolence"), hp.alias("power"))).filter("benevolence <> 0 OR power <> 0")
    edge = W.partitionBy(*keys)
    told = signals.select("*", *O.derived(F.col("benevolence"), F.col("power")), F.row_number().over(edge.orderBy(F.col("event_id").desc())).alias("r"), F.count(F.lit(1)).over(edge).alias("m"))
    late = F.pow(F.lit(1 - ALPHA), F.col("r") - 1)
    moved = {n: F.sum(ALPHA * late * F.col(n)).alias(f"{n}_1") for n in ("benevolence", "power", "intensity", "fit")}
    begun = {n: F.sum(F.when(F.col("r") == F.col("m"), late).otherwise(ALPHA * late) * F.col(n)).alias(f"{n}_0") for n in moved}
    told = told.join(old.select(*keys, "last_event"), keys, "left")
    folded = told.groupBy(*keys).agg(
        F.max("m").alias("m"), F.max(F.when(F.col("r") == 1, F.col("orientation"))).alias("label"), *moved.values(), *begun.values(),
        F.max(F.coalesce((F.col("event_id") == F.col("last_event")).cast("int"), F.lit(0))).alias("known"),
    )
    before = old.select(*keys, *(F.col(c).alias(f"old_{n}") for c, n in (("benevolence", "benevolence"), ("power", "power"), ("intensity", "intensity"), ("confidence", "fit"))))
    both = folded.join(before, keys, "left")
    # a little more, so that sums in another order don't fall on two sides of a half
    value = lambda n: F.round(F.coalesce(F.pow(F.lit(1 - ALPHA), F.col("m")) * F.col(f"old_{n}") + F.col(f"{n}_1"), F.col(f"{n}_0")) + 1e-9, 5) + 0.0
    evidence = F.least(F.lit(EVIDENCE), F.col("m") + F.when(F.col("old_fit").isNotNull() & (F.col("known") == 0), 1).otherwise(0)).cast("long")
    return both.select(
        *keys, F.col("label").alias("orientation"), value("benevolence").alias("benevolence"), value("power").alias("power"), value("intensity").alias("intensity"),
        value("fit").alias("confidence"), evidence.alias("evidence"),
    )


@query(
    """, rule AS (SELECT observer, subject, shared, CASE WHEN shared >= 10 THEN least(1.0::DOUBLE, 0.3 + 0.4 * s) ELSE least(1.0::DOUBLE, 0.1 + 0.3 * s) END AS benevolence, CASE WHEN shared >= 10 THEN 0.2 ELSE 0 END AS power
  FROM (SELECT *, least(1.0::DOUBLE, 0.3 + 0.05 * shared) AS s FROM shared WHERE scope = 'R'))
SELECT coalesce(r.observer, i.observer) AS observer, coalesce(r.subject, i.subject) AS subject, shared, round(coalesce(0.4 * r.benevolence + 0.6 * i.benevolence, r.benevolence, i.benevolence), 6)::DOUBLE + 0.0 AS benevolence,
  round(coalesce(0.4 * r.power + 0.6 * i.power, r.power, i.power), 6)::DOUBLE + 0.0 AS power
FROM rule r FULL JOIN (SELECT * FROM impressions WHERE scope = 'R') i USING (observer, subject)""",
    IMPRESSIONS, _SAID, _SHARED,
)
def reanalyze_scope(spark, sf_dir):
    """The edges of one scope, moved towards what the events shared in it say; edges that share none stay."""
    rule = O.reanalyze(_shared(spark, sf_dir).filter("scope = 'R'").drop("scope"))
    old = impressions(spark, sf_dir).filter("scope = 'R'")
    out = O.smooth(old, rule.select("observer", "subject", "benevolence", "power"), ["observer", "subject"], ["benevolence", "power"], ALPHA)
    out = out.join(rule.select("observer", "subject", "shared"), ["observer", "subject"], "left")
    return out.select("observer", "subject", "shared", *((F.round(c, 6) + 0.0).alias(c) for c in ("benevolence", "power")))


@query(
    """, met AS (SELECT a.uid AS observer, b.uid AS subject, a.event_id FROM said a JOIN said b ON a.event_id = b.event_id AND a.uid <> b.uid
  QUALIFY row_number() OVER (PARTITION BY a.uid, b.uid ORDER BY a.event_id DESC) <= 100),
pairs AS (SELECT observer, subject, count(*) AS evidence, min(event_id) AS oldest, max(event_id) AS newest FROM met GROUP BY ALL)
SELECT observer, subject, scope, orientation, round(intensity, 6)::DOUBLE AS intensity, round(fit, 6)::DOUBLE AS confidence, coalesce(evidence, 0) AS evidence, oldest, newest FROM projected LEFT JOIN pairs USING (observer, subject)""",
    IMPRESSIONS, _PROJECTED, _SAID,
)
def impression_recalc(spark, sf_dir):
    """Derived fields from benevolence and power anew, confidence from the fit, evidence from the newest hundred shared events."""
    rows, _ = said(spark, sf_dir)
    newest = O.newest_shared(rows.select("event_id", "uid"), EVIDENCE)
    pairs = newest.groupBy("observer", "subject").agg(F.count(F.lit(1)).alias("evidence"), F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"))
    return _projected(spark, sf_dir).join(pairs, ["observer", "subject"], "left").select(
        "observer", "subject", "scope", "orientation", F.round("intensity", 6).alias("intensity"), F.round("fit", 6).alias("confidence"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"), "oldest", "newest",
    )


#: Members of groups: who showed up in every 97th event; a group's scope, and the private one's.
_GROUPS = """joined AS (SELECT DISTINCT CASE WHEN event_type = 'signup' THEN '__private__' WHEN event_type = 'click' THEN 'R' WHEN event_type = 'view' THEN 'A' ELSE event_type END AS group_id, user_id % 40 AS uid FROM events),
inside AS (SELECT s.group_id, e.* FROM projected e JOIN joined s ON s.uid = e.observer JOIN joined t ON t.uid = e.subject AND t.group_id = s.group_id WHERE e.scope = CASE WHEN s.group_id = '__private__' THEN 'N' ELSE s.group_id END)"""


def joined(spark, sf_dir):
    kind = F.col("event_type")
    group = F.when(kind == "signup", "__private__").when(kind == "click", "R").when(kind == "view", "A").otherwise(kind)
    return table(spark, sf_dir, "events").select(group.alias("group_id"), (F.col("user_id") % 40).alias("uid")).distinct()


def inside(spark, sf_dir):
    """Edges of which both ends are members of a group, in the scope that the group stands for."""
    own = joined(spark, sf_dir)
    scope = F.when(F.col("group_id") == "__private__", "N").otherwise(F.col("group_id"))
    at = own.select("group_id", F.col("uid").alias("observer"), scope.alias("scope"))
    both = _projected(spark, sf_dir).join(at, ["observer", "scope"])
    return both.join(own.select("group_id", F.col("uid").alias("subject")), ["group_id", "subject"], "left_semi")


@query("SELECT group_id, observer, subject, scope FROM inside", IMPRESSIONS, _PROJECTED, _GROUPS)
def edges_within_group(spark, sf_dir):
    return inside(spark, sf_dir).select("group_id", "observer", "subject", "scope")


@query(
    """, tags AS (SELECT group_id, tag, count(*) AS n FROM (SELECT group_id, unnest(['t' || uid % 7, 's' || uid % 3]) AS tag FROM joined) GROUP BY group_id, tag QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, tag) <= 4),
active AS (SELECT user_id % 40 AS uid, max(ts) AS last_active FROM events GROUP BY 1)
SELECT c.*, coalesce(pairs, 0) AS edge_pairs, top_tags FROM (SELECT group_id, count(*) AS nodes, count(*) FILTER (uid % 10 <> 0) AS members, max(last_active) AS last_active FROM joined JOIN active USING (uid) GROUP BY group_id) c
LEFT JOIN (SELECT group_id, count(DISTINCT (least(observer, subject), greatest(observer, subject))) AS pairs FROM inside GROUP BY 1) USING (group_id)
LEFT JOIN (SELECT group_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS top_tags FROM tags GROUP BY 1) USING (group_id) ORDER BY last_active DESC""",
    IMPRESSIONS, _PROJECTED, _GROUPS,
)
def group_cards_full(spark, sf_dir):
    """A card per group: people, bots apart, pairs of edges inside it, its last activity and four top tags; the latest first."""
    own = joined(spark, sf_dir)
    active = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("uid")).agg(F.max("ts").alias("last_active"))
    cards = own.join(active, "uid").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum((F.col("uid") % 10 != 0).cast("long")).alias("members"), F.max("last_active").alias("last_active")
    )
    pair = F.struct(F.least("observer", "subject"), F.greatest("observer", "subject"))
    pairs = inside(spark, sf_dir).groupBy("group_id").agg(F.countDistinct(pair).alias("edge_pairs"))
    tag = lambda letter, k: F.concat(F.lit(letter), (F.col("uid") % k).cast("string"))
    counts = own.select("group_id", F.explode(F.array(tag("t", 7), tag("s", 3))).alias("tag")).groupBy("group_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    top = windows.latest_per_group(counts, "group_id", [F.col("n").desc(), "tag"], 4)
    tags = top.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))).alias("t"))
    tags = tags.select("group_id", F.array_join(F.transform("t", lambda t: t.tag), ",").alias("top_tags"))
    out = cards.join(pairs, "group_id", "left").join(tags, "group_id", "left").orderBy(F.col("last_active").desc())
    return out.select("group_id", "nodes", "members", "last_active", F.coalesce("edge_pairs", F.lit(0)).alias("edge_pairs"), "top_tags")


_OWNED = "owned AS (SELECT observer, subject, scope, CASE WHEN (observer + subject) % 3 > 0 THEN 'p' || ((observer + subject) % 3) END AS persona, benevolence FROM impressions)"


def _owned(spark, sf_dir):
    """Impressions by persona; a third are from before there were any."""
    kind = (F.col("observer") + F.col("subject")) % 3
    persona = F.when(kind > 0, F.concat(F.lit("p"), kind.cast("string")))
    return impressions(spark, sf_dir).select((F.col("observer") % 20).alias("observer"), "subject", "scope", persona.alias("persona"), "benevolence")


_OWN = "own AS (SELECT observer % 20 AS observer, subject, scope, persona, benevolence FROM owned), one AS (SELECT observer, subject, scope, persona, max(benevolence) AS benevolence FROM own GROUP BY ALL)"


def _one(spark, sf_dir):
    return _owned(spark, sf_dir).groupBy("observer", "subject", "scope", "persona").agg(F.max("benevolence").alias("benevolence"))


@query(
    "SELECT * FROM one WHERE persona IS NOT NULL UNION ALL SELECT observer, subject, scope, 'p1', benevolence FROM one o WHERE persona IS NULL AND NOT EXISTS "
    "(SELECT 1 FROM one t WHERE (t.observer, t.subject, t.scope) = (o.observer, o.subject, o.scope) AND t.persona = 'p1')",
    IMPRESSIONS, _OWNED, _OWN,
)
def merge_legacy_null(spark, sf_dir):
    """Rows from before there were personas move to one; where it has a row of its own, that stays."""
    return L.merge_persona(_one(spark, sf_dir), "persona", None, "p1", ["observer", "subject", "scope"])


@query(
    "SELECT * FROM one o WHERE NOT (scope = 'R' AND subject % 5 = 0) UNION ALL SELECT observer, subject, scope, persona, -benevolence FROM one WHERE scope = 'R' AND subject % 5 = 0 "
    "UNION ALL SELECT 99, subject, 'R', NULL, 0.5 FROM one WHERE subject % 5 = 0 GROUP BY subject",
    IMPRESSIONS, _OWNED, _OWN,
)
def upsert_impression(spark, sf_dir):
    """New values for some edges, with or without a persona, and edges that weren't there."""
    rows = _one(spark, sf_dir)
    keys = ["observer", "subject", "scope", "persona"]
    changed = rows.filter("scope = 'R' AND subject % 5 = 0").withColumn("benevolence", -F.col("benevolence"))
    new = rows.filter("subject % 5 = 0").select(F.lit(99).cast("long").alias("observer"), "subject", F.lit("R").alias("scope"), F.lit(None).cast("string").alias("persona"), F.lit(0.5).alias("benevolence")).distinct()
    return L.upsert(rows, changed.unionByName(new), keys, ("persona",))


@query(
    """, src AS (SELECT o.*, EXISTS (SELECT 1 FROM one t WHERE (t.observer, t.subject, t.scope) = (o.observer, o.subject, o.scope) AND t.persona = 'p1') AS clash FROM one o WHERE persona = 'p2')
SELECT count(*) FILTER (NOT clash) AS impressions_moved, count(*) FILTER (clash) AS impressions_dropped, (SELECT count(*) FROM events WHERE user_id % 3 = 2) AS events_moved,
  (SELECT count(*) FROM customer WHERE c_custkey % 3 = 2) AS personas_moved FROM src""",
    IMPRESSIONS, _OWNED, _OWN,
)
def merge_preview_all(spark, sf_dir):
    """What a merge of one persona into another would move and drop, in impressions, events and people."""
    out = L.merge_preview(_one(spark, sf_dir), "persona", "p2", "p1", ["observer", "subject", "scope"])
    count = lambda name, when, alias: table(spark, sf_dir, name).filter(when).agg(F.count(F.lit(1)).alias(alias))
    # single rows
    out = out.crossJoin(count("events", "user_id % 3 = 2", "events_moved")).crossJoin(count("customer", "c_custkey % 3 = 2", "personas_moved"))
    return out.select(F.col("moved").cast("long").alias("impressions_moved"), F.col("dropped").cast("long").alias("impressions_dropped"), "events_moved", "personas_moved")
