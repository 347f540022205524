"""Operator 8: near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits from the XXH64 of all 3-word shingles. Two fingerprints link at 3 or fewer differing
bits. Every bit position gets a non-zero vector of four bits; mask v keeps the positions whose vector has an odd
product with v. Any three positions leave some v that is even with all three, so every pair within the radius
agrees under one of the 15 masks: no link is lost.

Exact copies collapse into one fingerprint before the search. A bucket (mask, kept bits) with more than
``BUCKET_CAP`` fingerprints is not compared: its members differ only in the bits that the mask drops, and the same
construction on those bits splits it further. Each level about halves the free bits (64, 30, 14, 6), so buckets end
with at most 2**6 members: the cap costs no pair. A bucket gives a spanning tree per component in which no member has
more than ``FAN`` others below it, not its pairs and no hub. Components then join by hooking to the smallest neighbour and
jumping, with lineage cut each round.

Rows get their component by fingerprint. A fingerprint of more than a ``SHARE`` of all rows (copies of one text, texts
without words) would be one key of a join, but there are fewer than 1 / ``SHARE`` of those, so they travel by broadcast.

``deduplicate`` doesn't shuffle the texts: rows that go, and keys with repeated rows, are marked in a Bloom filter whose size
follows their number up to 64 MB; what isn't marked stays where it stands, and only marked rows, few of them by mistake, meet
the exact join. The filter only saves work: when it is full, more rows meet the join.

Defined cases: a null text is empty; texts without words have fingerprint zero and link like any other; repeated
rows share a fingerprint; null doc_ids have a fingerprint but never name a component that has another id; an empty
table gives no rows; other columns are kept by ``deduplicate`` and ignored by ``fingerprints``. ``deduplicate`` keeps
one row of every component, also where rows have no doc_id or share one over different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import cut, utf8

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET_CAP = 8192
#: Shingles whose bits are added at once.
CHUNK = 1 << 15
FAN = 8
SHARE = 1 / 1000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned: a bit is 1 if it is set in over half the shingles' hashes."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)]
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(parts), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts[at : at + CHUNK]], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _text_key():
    """Tells apart the texts of one doc_id, and rows without a doc_id from those that have the stand-in -1."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def masks(free: int, radius: int = RADIUS) -> list[int]:
    """Covering masks (unsigned) over the set bits of ``free``: each keeps about half of them."""
    size = 1 << (radius + 1)
    places = [i for i in range(64) if free >> i & 1]
    vector = {place: 1 + k % (size - 1) for k, place in enumerate(places)}
    return [sum(1 << place for place in places if (vector[place] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree(values) -> list[tuple[int, int]]:
    """Edges of trees that span the components of the graph of pairs within the radius in one bounded bucket."""
    v = np.unique(np.asarray(values, dtype=np.int64).view(np.uint64))
    seen, out = np.zeros(len(v), dtype=bool), []
    for i in range(len(v)):
        if seen[i]:
            continue
        seen[i], members, at = True, [i], 0
        while at < len(members):
            near = np.flatnonzero((np.bitwise_count(v ^ v[members[at]]) <= RADIUS) & ~seen)
            seen[near] = True
            members += near.tolist()
            at += 1
        signed = v[members].view(np.int64).tolist()
        out += [(signed[k], signed[(k - 1) // FAN]) for k in range(1, len(signed))]
    return out


def _trees(buckets: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in buckets:
        edges = [e for fps in b.column("fps").to_pylist() for e in _tree(fps)]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(fps: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """a, b: edges whose components are those of all pairs of distinct ``fp`` within the radius."""
    level = fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("kept"))
    paths = {"": (1 << 64) - 1}  # path of masks taken -> bits still free
    found = None
    while paths:
        # free bits depend on the path only, so the masks of a level are a small list: 15 ** depth at most
        choices = {p: masks(free) for p, free in paths.items()}
        table = fps.sparkSession.createDataFrame(
            [(p, [(f"{p}{i:x}", _signed(m)) for i, m in enumerate(o)]) for p, o in choices.items()],
            "path string, next array<struct<path:string,mask:bigint>>",
        )
        keyed = level.join(F.broadcast(table), "path").select("fp", "kept", F.explode("next").alias("next"))
        kept = F.col("kept").bitwiseOR(F.col("fp").bitwiseAND(F.col("next.mask")))
        keyed = keyed.select("fp", F.col("next.path").alias("path"), kept.alias("kept"))
        # buckets are counted before they are brought together; those over the cap never are
        sizes = keyed.groupBy("path", "kept").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        paths = {f"{p}{i:x}": paths[p] & ~m for p, o in choices.items() for i, m in enumerate(o)}
        last = all(1 << free.bit_count() <= cap for free in paths.values())
        light = sizes if last else sizes.filter(F.col("n") <= cap)
        buckets = keyed.join(light.drop("n"), ["path", "kept"]).groupBy("path", "kept").agg(F.collect_list("fp").alias("fps"))
        edges = buckets.select("fps").mapInArrow(_trees, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if last:
            break
        level = cut(keyed.join(sizes.filter(F.col("n") > cap).drop("n"), ["path", "kept"], "left_semi").select("fp", "path", "kept"))
        paths = {r.path: paths[r.path] for r in level.select("path").distinct().collect()}  # at most 15 ** depth
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: the smallest fp that is reachable, for every end of an edge."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = both.groupBy(F.col("u").alias("fp")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    while True:
        label = cut(label)
        jump = label.select(F.col("fp").alias("root"), F.col("root").alias("next"))
        jumped = label.join(jump, "root").select("fp", F.col("root").alias("old"), F.col("next").alias("root"))
        near = (
            both.join(jumped.select(F.col("fp").alias("v"), F.col("root").alias("other")), "v")
            .groupBy(F.col("u").alias("fp")).agg(F.min("other").alias("other"))
        )
        moved = jumped.join(near, "fp").select("fp", "old", F.least("root", "other").alias("root"))
        # a root hooks to the smallest root that one of its members has met
        hooks = moved.groupBy(F.col("old").alias("fp")).agg(F.min("root").alias("hook"))
        label_next = cut(moved.join(hooks, "fp", "left").select("fp", "old", F.least("root", F.coalesce("hook", "root")).alias("root")))
        if label_next.filter("root <> old").isEmpty():
            return label_next.select("fp", "root")
        label = label_next.select("fp", "root")


def linked(docs: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """doc_id, text_key, fp, root, component_id (the smallest doc_id reachable), size (rows of the component): one row per input row."""
    rows = cut(fingerprints(docs))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    classes = components(links(groups.select("fp"), cap))
    named = groups.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    by_fp = named.select("fp", "root", "n").join(least, "root").select("fp", "root", "component_id", "size", "n")
    often = SHARE * (groups.agg(F.sum("n")).first()[0] or 0)
    # fewer than 1 / SHARE fingerprints are that frequent
    heavy, light = (by_fp.filter(c).drop("n") for c in (F.col("n") > often, F.col("n") <= often))
    hot = F.broadcast(groups.filter(F.col("n") > often).select("fp"))
    return rows.join(F.broadcast(heavy), "fp").unionByName(rows.join(hot, "fp", "left_anti").join(light, "fp"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return linked(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    rows = cut(linked(docs))
    kept = rows.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id")
    first = kept.select(id_, "text_key")
    key = F.xxhash64("id", "text_key").alias("key")
    # where a component has several rows, all but its first one go, and copies of that
    crowded = rows.filter("size > 1").select(id_, "text_key").groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    goes = cut(crowded.join(first.withColumn("is_first", F.lit(True)), ["id", "text_key"], "left").filter("is_first IS NULL OR n > 1").select(key))
    maybe = bloom.may_hold(docs.sparkSession, bloom.build(goes, goes.count()))
    # the row travels as one struct, so its names can't clash with the ones used here
    placed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), _text_key().alias("text_key")).select("row", id_, "text_key")
    marked = placed.withColumn("marked", maybe(key))
    rest = marked.filter("marked").drop("marked")
    once = rest.join(first, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    return marked.filter("NOT marked").select("row.*").unionByName(once.select("row.*"))
