"""Queries that render texts and read them back: Markdown files, prompts, injected blocks, output of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import markdown, text
from tidemark.functions import prompts as P
from tidemark.operators import social as O
from tidemark.plans.registry import query
from tidemark.plans.social import _PROJECTED
from tidemark.sources.tables import IMPRESSIONS, MEMORIES, impressions, memories, table


@query(
    "SELECT subject, observer::VARCHAR AS observer, scope, orientation, benevolence, power, round_even(intensity * 100, 0) / 100 AS intensity, "
    "round_even(fit * 100, 0) / 100 AS fit, round_even(confidence * 100, 0) / 100 AS confidence, last_event::VARCHAR AS evidence FROM projected",
    IMPRESSIONS, _PROJECTED,
)
def markdown_impressions(spark, sf_dir):
    """Every impression through its Markdown file and back."""
    rows = impressions(spark, sf_dir).select("*", *O.derived(F.col("benevolence"), F.col("power")), F.array("last_event").alias("evidence"))
    out = markdown.parse(markdown.render(rows))
    return out.withColumn("evidence", F.array_join("evidence", ","))


_WRAPPED = "'<memory>' || chr(10) || text || chr(10) || '</memory>'"


@query(
    f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'be brief' || chr(10) || chr(10) || {_WRAPPED} ELSE 'be brief' END AS system_prompt,
  CASE event_id % 3 WHEN 1 THEN {_WRAPPED} || chr(10) || chr(10) || lang WHEN 2 THEN lang || chr(10) || chr(10) || {_WRAPPED} ELSE lang END AS prompt FROM memories""",
    MEMORIES,
)
def inject_position(spark, sf_dir):
    """The memory block put behind the system prompt, before or behind the user's message."""
    rows = memories(spark, sf_dir)
    position = F.element_at(F.array(*map(F.lit, P.POSITIONS[:3])), (F.col("event_id") % 3 + 1).cast("int"))
    system, prompt = P.inject(F.lit("be brief"), F.col("lang"), F.col("text"), position)
    return rows.select("event_id", system.alias("system_prompt"), prompt.alias("prompt"))


@query("SELECT event_id, 'be brief' AS system_prompt, text AS prompt FROM memories", MEMORIES)
def clear_injection(spark, sf_dir):
    """What was injected is found by its marks and taken out; the whole text stays as it was."""
    position = F.element_at(F.array(*map(F.lit, P.POSITIONS[:3])), (F.col("event_id") % 3 + 1).cast("int"))
    system, prompt = P.inject(F.lit("be brief"), F.col("text"), F.concat("lang", F.lit("\n"), "group_id"), position)
    rows = memories(spark, sf_dir).select("event_id", system.alias("system_prompt"), prompt.alias("prompt"))
    return rows.select("event_id", *(P.clear(F.col(c)).alias(c) for c in ("system_prompt", "prompt")))


@query(
    "SELECT conv_id, 'assistant,tool' AS roles, count(*) AS said, count(*) FILTER (role <> 'system') AS kept FROM conversations GROUP BY conv_id"
)
def tool_call_messages(spark, sf_dir):
    """Contexts with a made-up call and its answer in front; taking such pairs out leaves the turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("content"), F.lit(None).cast("string").alias("call_id")))
    pair = P.tool_pair(F.concat(F.lit("memory-"), F.col("conv_id").cast("string")), F.lit("recalled"))
    rows = turns.select("conv_id", pair.alias("pair"), F.concat(pair, said).alias("context"))
    without = P.without_tool_pairs(F.col("context"))
    return rows.select(
        "conv_id", F.array_join(F.transform("pair", lambda p: p.role), ",").alias("roles"), F.size(without).cast("long").alias("said"),
        F.size(F.filter(without, lambda m: m.role != "system")).cast("long").alias("kept"),
    )


@query(
    "SELECT conv_id, 0 AS start_idx, (count(*) - 1)::INTEGER AS end_idx, substr(repeat('topic ' || conv_id || ' ', 12), 1, 60) AS topic, 'tag0,tag1,tag2,tag3,tag4' AS tags, "
    "least(1.0::DOUBLE, conv_id / 50.0::DOUBLE) AS salience, 0.5::DOUBLE AS confidence FROM conversations GROUP BY conv_id"
)
def parse_model_json(spark, sf_dir):
    """A model's fenced JSON array: the item that points beyond the window goes, fields are cut and clamped."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    item = lambda end: F.struct(
        F.lit(0).alias("start_idx"), end.cast("int").alias("end_idx"), F.repeat(F.concat(F.lit("topic "), F.col("conv_id").cast("string"), F.lit(" ")), 12).alias("topic"),
        F.lit("s").alias("summary"), F.array(*(F.lit(f"tag{i}") for i in range(7))).alias("chat_content_tags"), (F.col("conv_id") / 50.0).alias("salience"),
    )
    answer = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.array(item(F.col("n") - 1), item(F.col("n")))), F.lit("\n```"))
    rows = n.select("conv_id", "n", answer.alias("answer"))
    items = rows.select("conv_id", F.explode(text.parse_extraction(F.col("answer"), F.col("n") - 1)).alias("x"))
    return items.select("conv_id", "x.start_idx", "x.end_idx", "x.topic", F.array_join("x.tags", ",").alias("tags"), "x.salience", "x.confidence")


@query(
    "SELECT c_custkey AS uid, 'A' AS trait, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, round(c_acctbal / 5000, 2)))::DOUBLE AS value, c_name AS evidence FROM customer"
)
def parse_personality(spark, sf_dir):
    """Trait scores of a model's JSON object, nested with evidence, clamped; unknown traits go."""
    score = F.round(F.col("c_acctbal") / 5000, 2)
    own = F.struct(F.struct(score.alias("A"), F.lit(0.5).alias("Z")).alias("scores"), F.col("c_name").alias("evidence"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(own.alias("u"))).alias("j"))
    parsed = rows.select("c_custkey", F.explode(text.parse_traits(F.col("j"))).alias("who", "p"))
    return parsed.select(F.col("c_custkey").alias("uid"), F.explode("p.scores").alias("trait", "value"), F.col("p.evidence").alias("evidence"))


@query("SELECT p_partkey AS id, p_name AS what, p_brand AS who, p_type AS how, p_size::VARCHAR AS eval FROM part")
def parse_summary_topics(spark, sf_dir):
    """Summaries of marked parts, taken apart; an empty topic between bars counts for nothing."""
    mark = lambda name, c: F.concat(F.lit(f"[{name}] "), F.col(c).cast("string"), F.lit(" "))
    summary = F.concat(F.lit(" | "), mark("What", "p_name"), mark("Who", "p_brand"), mark("How", "p_type"), mark("Eval", "p_size"), F.lit("|"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(text.parse_topics(summary)).alias("t"))
    return rows.select("id", "t.what", "t.who", "t.how", "t.eval")


@query("SELECT o_orderkey AS id, trim(o_orderpriority) AS answer FROM orders")
def strip_think(spark, sf_dir):
    said = F.concat(F.lit("<think>first\n"), F.col("o_orderstatus"), F.lit("</think>\n"), F.col("o_orderpriority"), F.lit("<think></think>"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.strip_thoughts(said).alias("answer"))


_TRAIT = "(s_suppkey * 13 % 201 - 100) / 100.0::DOUBLE"


@query(
    f"SELECT s_suppkey AS uid, round_even(({_TRAIT} + 1) / 2 * 100, 0)::INTEGER AS percent, 'calm at ' || round_even(({_TRAIT} + 1) / 2 * 100, 0)::INTEGER || '% of ' || s_name AS evidence FROM supplier"
)
def evidence_percent(spark, sf_dir):
    """Percentages in a model's evidence are set to those of the score."""
    percent = text.percent_of_trait((F.col("s_suppkey") * 13 % 201 - 100) / 100.0)
    said = F.concat(F.lit("calm at 7% of "), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), percent.alias("percent"), text.with_percent(said, percent).alias("evidence"))


@query(
    f"SELECT s_suppkey AS uid, s_name || chr(10) || '- A ' || round_even(({_TRAIT} + 1) / 2 * 100, 0)::INTEGER || '%：' || substr(s_name, 1, 60) AS profile FROM supplier"
)
def format_persona(spark, sf_dir):
    traits = F.create_map(F.lit("A"), (F.col("s_suppkey") * 13 % 201 - 100) / 100.0)
    lines = P.persona_lines(F.col("s_name"), traits, F.create_map(F.lit("A"), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), lines.alias("profile"))


@query(
    "SELECT group_id, '# ' || group_id || chr(10) || '## 主要话题' || chr(10) || string_agg('- ' || event_id || ' ' || lang, chr(10) ORDER BY event_id) || chr(10) || "
    "'## 事件' || chr(10) || count(*) || chr(10) || '## 情感' || chr(10) || round(avg(salience), 2) AS document FROM memories WHERE status = 'active' GROUP BY group_id",
    MEMORIES,
)
def summary_build(spark, sf_dir):
    """A document of three sections for each group; the day's narrative is a few lines of each of its episodes."""
    rows = memories(spark, sf_dir, text=False).filter("status = 'active'")
    groups = rows.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "lang"))).alias("e"), F.count(F.lit(1)).alias("n"), F.round(F.avg("salience"), 2).alias("mean")
    )
    topics = F.array_join(F.transform("e", lambda e: F.concat(F.lit("- "), e.event_id.cast("string"), F.lit(" "), e.lang)), "\n")
    document = F.concat_ws("\n", F.concat(F.lit("# "), F.col("group_id")), F.lit("## 主要话题"), topics, F.lit("## 事件"), F.col("n").cast("string"), F.lit("## 情感"), F.col("mean").cast("string"))
    return groups.select("group_id", document.alias("document"))


@query(
    "SELECT s_suppkey AS uid, CASE WHEN s_acctbal / 10000 >= 0.6 THEN 'positive' WHEN s_acctbal / 10000 <= -0.6 THEN 'negative' ELSE 'neutral' END AS affect FROM supplier"
)
def format_affect(spark, sf_dir):
    label = text.affect_label(F.col("s_acctbal") / 10000)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.regexp_extract(label, "^[a-z]+", 0).alias("affect"))
