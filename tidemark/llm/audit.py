"""Operator 11: how the order of filters changes what they remove, as products of incidence matrices.

A document is a mask of the filters that it fails. Per part, the documents, the good ones and the toxic ones are counted by
mask: three histograms of 32 masks. What an order of the filters keeps or removes at a step depends on the mask alone, so all
600 pairs of order and step are one integer matrix of 32 by 600 for each outcome (kept, removed, redundant, unique), and the
histograms, stacked as rows, are multiplied by them. Texts leave their tasks as digests only; what is counted is summed before
it is shuffled, so neither a hot part nor a hot text meets in one task.

Defined cases: a null text is empty and a null part is the empty string; words, code points and letters of an empty text are 0,
so it fails A and nothing else by itself; E looks at texts of smaller doc_ids in the whole table, so repeated rows of one doc_id
don't fail it for each other, and a row without doc_id never does; a document is good (toxic) if any row of ``labels`` says so,
and without labels it is neither; every row counts, repeated ones too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Parts that are multiplied at once.
BLOCK = 64
REPEATED = "E"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def row_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text shows by itself, by letter; ``REPEATED`` needs the table."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def letters() -> str:
    return "".join([*row_filters(F.lit("")), REPEATED])


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask (bit k: fails the k-th filter), n, good, toxic: documents by part and mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(row_filters(text).values())]
    own = sum(bits[1:], bits[0]).alias("own")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own)
    met = cut(rows.groupBy("doc_id", "digest", "part", "own").agg(F.count(F.lit(1)).alias("n")))
    # the pair of text and smallest id is a key of few rows, also where a text has very many
    first = met.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = met.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    repeated = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("own") + F.when(repeated, 1 << len(bits)).otherwise(0)
    of = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("part", mask.cast("int").alias("mask")).agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def outcome_matrices(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Pairs of order and step (from 1), and for each outcome an integer matrix: masks down, pairs across."""
    orders = ["".join(p) for p in permutations(names)]
    pairs = [(order, step) for order in orders for step in range(1, len(names) + 1)]
    bit = {name: 1 << k for k, name in enumerate(names)}
    own = np.array([bit[order[step - 1]] for order, step in pairs])
    before = np.array([sum(bit[x] for x in order[: step - 1]) for order, step in pairs])
    mask = np.arange(1 << len(names))[:, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    found = {"kept": (mask & (own | before)) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    found = {k: v.astype(np.int64) for k, v in found.items()}
    same = (own[:, None] == own).astype(np.int64)  # the same filter in any order, at any step
    return pairs, found | {"shapley": found["removed"] @ same}


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, and the ``OUTCOMES``: one row per part, order and step, zeros included."""
    names = letters()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, by = outcome_matrices(names)
        orders, steps = pa.array([o for o, _ in pairs]), np.array([s for _, s in pairs], dtype=np.int32)
        for b in batches:
            parts, counts = b.column("part").to_pylist(), b.column("counts").to_pylist()
            for at in range(0, len(parts), BLOCK):
                some = counts[at : at + BLOCK]
                stacked = np.zeros((3, len(some), 1 << len(names)), dtype=np.int64)
                for k, row in enumerate(some):
                    for c in row:
                        stacked[:, k, c["mask"]] = c["n"], c["good"], c["toxic"]
                n, good, toxic = stacked
                out = [n @ by["kept"], n @ by["removed"], n @ by["redundant"], n @ by["unique_fails"], good @ by["removed"], toxic @ by["removed"], n @ by["shapley"]]
                where = pa.array(np.repeat(np.arange(len(some)), len(pairs)))
                columns = [pa.array(parts[at : at + BLOCK], pa.string()).take(where), pa.chunked_array([orders] * len(some)).combine_chunks(), pa.array(np.tile(steps, len(some)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x.ravel()) for x in out], names=["part", "filter_order", "step", *OUTCOMES])

    counts = masks(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return counts.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in OUTCOMES))


ORACLE = """WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
failed AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND toxic = 1) AS toxic FROM words),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS own, fails = f AS only_own,
  length(translate(fails, before, '')) < length(fails) AS gone FROM counts, steps),
rows_ AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM rows_"""
