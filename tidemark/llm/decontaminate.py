"""Operator 5: benchmark windows in documents by Wu-Manber search over words.

Symbols are words. For the patterns of one length a shift table over blocks of two words says how far the window
can move without missing an occurrence; where it says 0, the bucket of that suffix block, split by the first word,
holds the patterns that direct comparison confirms. Patterns are the 10-word windows of the items, and the whole
item where it is shorter; each length has tables of its own.

The benchmark travels to the tasks as pairs (window, item) in blocks of at most ``BLOCK_WINDOWS``: pairs, not items, are
dealt by hash, and the blocks are counted before the first one is fetched, so neither a huge item nor a window that many
items share makes a block larger. More pairs mean more passes over the same documents, with the hits so far checkpointed
between them, so that driver and tasks hold the tables of one block at a time. A worker builds the tables of a block once.

A document carries the merged intervals of its hit words and the distinct items, not their product.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; an empty
benchmark hits nothing; items that share a window are all told; rows that repeat an item_id count as one item;
repeated documents are judged row by row; other columns are kept by ``with_hits`` and ignored by ``report``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, word_bytes

WINDOW = 10
BLOCK_WINDOWS = 200_000

_HITS = "n_words bigint, at array<int>, end array<int>, item array<string>"


class WuManber:
    """Tables for patterns (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.items = length, patterns
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[p[-self.block :]][p[0]].append(p)

    def find(self, words: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """Starts of all occurrences, and which pattern it is."""
        found, n, end, m, b = [], len(words), self.length, self.length, self.block
        shift, default = self.shift.get, self.default
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift(key, default)
            if step:
                end += step
                continue
            for p in self.buckets[key].get(words[end - m], ()):
                if p == tuple(words[end - m : end]):
                    found.append((end - m, p))
            end += 1
        return found


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Block:
    """Pairs of a window (words with one space between them) and an item; the tables are made where they are used, once."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs, self.made = pairs, None

    def tables(self) -> list[WuManber]:
        if self.made is None:
            by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
            for window, item in self.pairs:
                words = tuple(window.encode("utf-8", "surrogatepass").split(b" "))
                by_length[len(words)][words].append(item)
            self.made = [WuManber(dict(p), n) for n, p in sorted(by_length.items())]
        return self.made

    def hits(self, text: str | None) -> tuple[int, list[int], list[int], list[str]]:
        """Number of words, starts and ends of the merged intervals of hit words, and the distinct items."""
        words = word_bytes(text)
        spans, windows_ = set(), set()
        for search in self.tables():
            for at, window in search.find(words):
                spans.add((at, at + search.length))
                windows_.add((search.length, window))
        items = {search.length: search.items for search in self.tables()}
        starts, ends = [], []
        for at, end in sorted(spans):
            if ends and at <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(at)
                ends.append(end)
        return len(words), starts, ends, sorted({x for n, w in windows_ for x in items[n][w]})


def _finder(spark, block: Block):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(_HITS)
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.hits(t) for t in texts], columns=["n_words", "at", "end", "item"])

    return find


def pairs_of(benchmark: DataFrame) -> DataFrame:
    """window, item: each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                told = sorted({b" ".join(w).decode("utf-8", "surrogatepass") for w in windows(word_bytes(text))})
                for at in range(0, len(told), 10_000):
                    some = told[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([item] * len(some), pa.string())], names=["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string"))
    return items.mapInArrow(run, "window string, item string").distinct()


def _blocks(benchmark: DataFrame, block_windows: int) -> Iterator[Block]:
    """Blocks of bounded size; each is fetched by itself, when its turn comes. At least one, which may be empty."""
    pairs = cut(pairs_of(benchmark))
    total = pairs.count()
    n = max(1, -(-total // block_windows))
    while True:
        deal = F.pmod(F.xxhash64("window", "item"), F.lit(n)).alias("block")
        most = pairs.groupBy(deal).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= block_windows:
            break
        n += 1 + n // 8
    for k in range(n):
        yield Block(sorted((r.window, r.item) for r in pairs.filter(deal == k).collect()))


def with_hits(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds ``_n_words``, ``_hits`` (array<struct<at, end>> in order) and ``_items`` (distinct, in order); keeps all columns."""
    hits = F.arrays_zip(F.col("_part.at").alias("at"), F.col("_part.end").alias("end")).alias("_hits")
    blocks = _blocks(benchmark, block_windows)
    df = docs.withColumn("_part", _finder(docs.sparkSession, next(blocks))("text")).select("*", hits, F.col("_part.item").alias("_items"), F.col("_part.n_words").alias("_n_words")).drop("_part")
    more = None
    for block in blocks:
        if more is None:  # texts are written once, with numbers that a lost executor can't change
            df = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        found = df.select("_row", _finder(docs.sparkSession, block)("text").alias("_part")).filter(F.size("_part.at") > 0).select("_row", hits, F.col("_part.item").alias("_items"))
        more = found if more is None else more.unionByName(found)
    if more is not None:
        joined = more.groupBy("_row").agg(F.flatten(F.collect_list("_hits")).alias("_more"), F.flatten(F.collect_list("_items")).alias("_also"))
        none = lambda c, own: F.coalesce(c, F.filter(own, lambda x: F.lit(False)))
        df = df.join(joined, "_row", "left").withColumns({"_hits": F.concat("_hits", none("_more", "_hits")), "_items": F.array_union("_items", none("_also", "_items"))}).drop("_row", "_more", "_also")
    return df.withColumn("_hits", F.array_sort("_hits")).withColumn("_items", F.array_sort("_items"))


def _covered(hits: str):
    """Words inside any hit: hits come in order of their places."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a.end, x.end).alias("end"),
            (a.n + F.greatest(F.lit(0), x.end - F.greatest(a.end, x["at"]))).alias("n"),
        ),
        lambda a: a.n,
    )


def report(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per input row."""
    df = with_hits(docs.select("doc_id", "text"), benchmark, block_windows)
    df = df.select("doc_id", F.col("_n_words").alias("n_words"), _covered("_hits").alias("n_hit"), F.col("_items").alias("items"))
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs; all their columns."""
    # the row travels as one struct, so its names can't clash with the ones used here
    rows = docs.select(F.struct("*").alias("row"), "text")
    return with_hits(rows, benchmark).filter(F.size("_hits") == 0).select("row.*")


ORACLE = """
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
),
doc_windows AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM doc_words, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)
),
hits AS (SELECT doc_id, i, d.m, item_id FROM doc_windows d JOIN item_windows USING (m, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
