"""Files in and out: chat logs, Markdown trees, summaries by group and day, audit lines, versioned snapshots.

Paths go through Spark's readers and Hadoop's file systems, so any store that Spark reads will do. Snapshots are
directories ``version=N`` under a base path; a version that has no ``_SUCCESS`` mark was never finished and is not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT = "role string, nickname string, time string, content string"
PRIVATE = "__private__"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def chat_log(spark: SparkSession, path: str) -> DataFrame:
    """file, position, role, nickname, time, content of JSON arrays of messages; their order is that of the array."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{_struct(CHAT)}>>").alias("m"))
    return files.select("file", F.posexplode("m").alias("position", "x")).select("file", "position", "x.*")


def _struct(columns: str) -> str:
    return ",".join(":".join(c.split()) for c in columns.split(","))


def markdown_tree(spark: SparkSession, path: str, name: str = "IMPRESSIONS.md") -> DataFrame:
    """subject (the folder a file lies in), content."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("subject"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, length of all files below a path; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of a listing that are new or have another time than in an earlier one."""
    return now.join(before.select("path", "modified"), ["path", "modified"], "left_anti")


def write_summaries(rows: DataFrame, path: str) -> None:
    """group_id, date, document: one text file or more per group and day; private chats are a group of their own."""
    out = rows.select(F.coalesce("group_id", F.lit(PRIVATE)).alias("group_id"), F.col("date").cast("string").alias("date"), F.col("document").alias("value"))
    out.write.mode("append").partitionBy("group_id", "date").text(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """group_id, date, document: the newest day first in each group, private chats last."""
    rows = spark.read.schema("value string, group_id string, date string").text(path, wholetext=True).filter(F.col("date").rlike(_DATE))
    private = F.col("group_id") == PRIVATE
    # the writer ends a document with a line break
    return rows.orderBy(private, "group_id", F.col("date").desc()).select(
        F.when(~private, F.col("group_id")).alias("group_id"), "date", F.regexp_replace("value", r"\n\z", "").alias("document")
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """A JSON line per row behind those that are there."""
    rows.write.mode("append").json(path)


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, base: str) -> list[int]:
    """Finished snapshots in rising order. A directory listing: one entry per version."""
    fs, place = _filesystem(spark, base)
    if not fs.exists(place):
        return []
    names = [s.getPath() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def write_snapshot(rows: DataFrame, base: str) -> int:
    """Writes the next version beside the others and gives its number; readers of older ones aren't disturbed."""
    number = max(versions(rows.sparkSession, base), default=0) + 1
    rows.write.mode("overwrite").parquet(f"{base}/version={number}")
    return number


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version, the newest by default."""
    return spark.read.parquet(f"{base}/version={max(versions(spark, base)) if version is None else version}")


def prune_snapshots(spark: SparkSession, base: str, keep: int = 1, older_than: float | None = None) -> list[int]:
    """Removes all but the newest ``keep`` versions (one at least); with a time (seconds since the epoch) only what was written before it."""
    gone = versions(spark, base)[: -max(1, keep)]
    if older_than is not None:
        fs, place = _filesystem(spark, base)
        written = {n: fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/version={n}/_SUCCESS")).getModificationTime() / 1000 for n in gone}
        gone = [n for n in gone if written[n] < older_than]
    for number in gone:
        fs, place = _filesystem(spark, f"{base}/version={number}")
        fs.delete(place, True)
    return gone


def migrate(rows: DataFrame, schema: dict[str, tuple[str, Column]], steps: list[tuple[int, Callable[[DataFrame], DataFrame]]], version: int) -> tuple[DataFrame, int]:
    """Applies the steps above ``version`` in order; then brings columns to ``schema`` (type and default of each)."""
    for number, step in sorted(steps, key=lambda s: s[0]):
        if number > version:
            rows, version = step(rows), number
    return rows.select(*((F.col(c) if c in rows.columns else default).cast(kind).alias(c) for c, (kind, default) in schema.items())), version
