"""Impressions as Markdown and back: one file per subject, a section per impression, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.circumplex import normalize_label
from tidemark.functions.text import affect_label

#: The headings and field names of the file format.
HEADING = ("## 来自 `", "` 的印象（范围：", "）")
ORIENTATION, BENEVOLENCE, POWER, INTENSITY, FIT, CONFIDENCE = "社交取向", "亲和度", "支配度", "情感强度", "拟合优度", "置信度"
EVIDENCE = "**依据事件：**"


def _row(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))


def _percent(x: Column) -> Column:
    return F.concat(F.rint(x * 100).cast("int").cast("string"), F.lit("%"))


def _signed(x: Column) -> Column:
    """``label（+0.50）``."""
    return F.regexp_replace(affect_label(x), r" \((.*)\)$", "（$1）")


def section(row: dict[str, Column]) -> Column:
    """One impression as a section; ``evidence`` is an array of ids and may be empty."""
    lines = [
        F.concat(F.lit(HEADING[0]), row["observer"].cast("string"), F.lit(HEADING[1]), row["scope"], F.lit(HEADING[2])),
        F.lit(""),
        _row(ORIENTATION, row["orientation"]),
        _row(BENEVOLENCE, _signed(row["benevolence"])),
        _row(POWER, _signed(row["power"])),
        _row(INTENSITY, _percent(row["intensity"])),
        _row(FIT, _percent(row["fit"])),
        _row(CONFIDENCE, _percent(row["confidence"])),
        F.when(F.size(row["evidence"]) > 0, F.concat(F.lit(f"\n{EVIDENCE}"), F.array_join(row["evidence"].cast("array<string>"), ", "))),
    ]
    return F.concat_ws("\n", *lines)


def render(impressions: DataFrame) -> DataFrame:
    """subject, content: the file of each subject, sections in the order of observer and scope."""
    one = section({c: F.col(c) for c in ("observer", "scope", "orientation", "benevolence", "power", "intensity", "fit", "confidence", "evidence")})
    rows = impressions.select("subject", F.struct("observer", "scope", one.alias("text")).alias("s"))
    files = rows.groupBy("subject").agg(F.array_sort(F.collect_list("s")).alias("s"))
    title = F.concat(F.lit("# "), F.col("subject").cast("string"))
    return files.select("subject", F.concat_ws("\n\n", title, F.transform("s", lambda s: s.text)).alias("content"))


def parse(files: DataFrame, key: str = "subject", content: str = "content") -> DataFrame:
    """key, observer, scope and the fields of every section that has all of them; shares are clamped."""
    parts = files.select(key, F.explode(F.split(content, r"(?m)^(?=## )")).alias("part"))
    field = lambda name, pattern: F.regexp_extract("part", rf"(?m)^\|\s*{name}\s*\|\s*{pattern}\s*\|", 1)
    number, percent = r"[^（|]*（([+-]?\d+\.\d+)）", r"(\d+)%"
    head = r"^## 来自\s+`([^`]+)`\s+的印象（范围：([^）]+)）"
    found = parts.select(
        key,
        F.regexp_extract("part", head, 1).alias("observer"),
        F.regexp_extract("part", head, 2).alias("scope"),
        F.trim(field(ORIENTATION, r"([^|]+)")).alias("orientation"),
        *(field(n, number).alias(c) for n, c in ((BENEVOLENCE, "benevolence"), (POWER, "power"))),
        *(field(n, percent).alias(c) for n, c in ((INTENSITY, "intensity"), (FIT, "fit"), (CONFIDENCE, "confidence"))),
        F.regexp_extract("part", r"(?m)^\*\*依据事件：\*\*\s*(.+)$", 1).alias("evidence"),
    )
    for c in ("observer", "orientation", "benevolence", "power", "intensity", "fit", "confidence"):
        found = found.filter(F.col(c) != "")
    side = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c).cast("double"))).alias(c)
    share = lambda c: F.least(F.lit(1.0), F.col(c).cast("double") / 100).alias(c)
    return found.select(
        key, "observer", "scope", normalize_label(F.col("orientation"), F.col("orientation")).alias("orientation"), side("benevolence"), side("power"),
        share("intensity"), share("fit"), share("confidence"),
        F.filter(F.split("evidence", r",\s*"), lambda e: e != "").alias("evidence"),
    )
