"""Written indexes: vectors by cell, texts by trigram. A question reads only the parts that can hold an answer.

Vectors: an inverted file over k-means cells, fitted on a sample of ``SAMPLE`` rows a cell, then covering every row. A search of
``probes`` cells is fast and may miss some; without ``probes`` it goes on to every cell that can still hold one of the best (no
member is nearer to a question than its cell's centre less the cell's angle), so it is exact.

Texts: trigrams of texts and of the entries of arrays, in lists of bounded length. Rows that hold all trigrams of a needle are
compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.tags import _matrix, _unit

#: Rows of the sample a cell, and its most; rounds of k-means; rows of a file; questions that travel together; cells that an exact search looks into first.
SAMPLE, MOST_SAMPLE, ROUNDS, FILE, QUESTIONS, FIRST = 64, 262_144, 12, 100_000, 4096, 8
#: Row numbers of a list of a trigram; pairs of row and trigram that a task keeps at a time.
LIST, HELD = 4096, 1_000_000


# vectors


def fit_cells(vectors: DataFrame, key: str, cells: int, seed: int = 7) -> np.ndarray:
    """Centres (unit vectors) by spherical k-means over a sample: the rows whose keys have the smallest hashes."""
    rows = vectors.filter("embedding IS NOT NULL").select(F.col("embedding").cast("array<double>"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    sample = rows.orderBy("h").limit(min(MOST_SAMPLE, SAMPLE * cells)).collect()
    if not sample:
        return np.zeros((0, 0))
    units = _unit(np.array([r.embedding for r in sample], dtype=float))
    centres = units[: min(cells, len(units))].copy()
    for _ in range(ROUNDS):
        at = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, units)
        full = np.linalg.norm(sums, axis=1) > 0  # an empty cell stays where it is
        centres[full] = _unit(sums[full])
    return centres


def write_cells(vectors: DataFrame, key: str, centres: np.ndarray, path: str) -> None:
    """Every row with a vector, by its nearest centre; large cells are many files. Beside them the cells with their angles."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column("embedding")) @ shared.value.T
                at = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("embedding"), pa.array(at), pa.array(s[np.arange(len(s)), at])], names=["key", "embedding", "cell", "similarity"])

    rows = vectors.filter("embedding IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.col("embedding").cast("array<double>"))
    placed = rows.mapInArrow(run, "key long, embedding array<double>, cell long, similarity double")
    sizes = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")))
    centre = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell long, centre array<double>")
    sizes.join(centre, "cell").coalesce(1).write.parquet(f"{path}/cells")
    file = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / FILE))
    dealt = placed.drop("similarity").join(F.broadcast(sizes.select("cell", "n")), "cell").withColumn("file", file)  # a row a cell
    files = sizes.agg(F.sum(F.ceil(F.col("n") / FILE))).first()[0] or 1
    dealt.repartition(files, "cell", "file").drop("n", "file").write.partitionBy("cell").parquet(f"{path}/vectors")


def _look(spark: SparkSession, path: str, key: str, asked: dict[int, np.ndarray], ids: np.ndarray, units: np.ndarray, k: int) -> DataFrame:
    """query_id, key, similarity: the best of each task. ``asked``: places of questions by cell; other cells are not read."""
    shared = spark.sparkContext.broadcast((asked, ids, units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, units = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, own, cell = b.column("key").to_numpy(), _matrix(b.column("embedding")), b.column("cell").to_numpy()
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for q, s in zip(asked[int(c)].tolist(), units[asked[int(c)]] @ own[rows].T):
                    held = best.get(q, (np.empty(0), np.empty(0, dtype=np.int64)))
                    s, names = np.concatenate([held[0], s]), np.concatenate([held[1], keys[rows]])
                    top = np.lexsort((names, -s))[:k]
                    best[q] = s[top], names[top]
        columns = [np.repeat(ids[list(best)], [len(s) for s, _ in best.values()])] + [np.concatenate([x[i] for x in best.values()] or [np.empty(0)]) for i in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", key, "similarity"])

    rows = spark.read.parquet(f"{path}/vectors").select("key", "embedding", F.col("cell").cast("long"))
    return rows.filter(F.col("cell").isin(*sorted(asked))).mapInArrow(run, f"query_id long, {key} long, similarity double")


def search_cells(spark: SparkSession, path: str, key: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, key, similarity, rank: the nearest ``k`` of (query_id, embedding); ties by key. Exact without ``probes``."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many as were asked for
    names = np.array([c.cell for c in cells], dtype=np.int64)
    centres, angle = np.array([c.centre for c in cells]), np.arccos(np.clip([c.least for c in cells], -1, 1))
    asked = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).filter("embedding IS NOT NULL")
    n_blocks = max(1, -(-asked.count() // QUESTIONS))
    deal, found = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)), None
    for number in range(n_blocks):
        some = sorted(tuple(r) for r in asked.filter(deal == number).collect())
        if not some or not len(names):
            continue
        ids, units = np.array([i for i, _ in some], dtype=np.int64), _unit(np.array([v for _, v in some], dtype=float))
        near = units @ centres.T
        chosen = np.zeros(near.shape, dtype=bool)
        first = np.argsort(-near, axis=1, kind="stable")[:, : probes or FIRST]
        chosen[np.arange(len(ids))[:, None], first] = True
        look = lambda held: _look(spark, path, key, {int(names[c]): np.flatnonzero(held[:, c]) for c in np.flatnonzero(held.any(axis=0))}, ids, units, k)
        part = look(chosen)
        if probes is None:
            part = cut(_ranked(part, key, k))
            worst = part.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s")).collect()  # a row a question
            least = {r.query_id: r.s for r in worst if r.n == k}
            reach = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - angle)) + 1e-9
            more = ~chosen & (reach >= np.array([least.get(int(i), -np.inf) for i in ids])[:, None])
            if more.any():
                part = part.drop("rank").unionByName(look(more))
            else:
                part = part.drop("rank")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, {key} long, similarity double, rank int")
    return _ranked(found, key, k)


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


# texts


def _grams(codes: np.ndarray) -> np.ndarray:
    """Distinct runs of three characters, as numbers, in order; ``codes``: code points, 21 bits each."""
    c = codes.astype(np.int64)
    return np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, places (key less the block's first): lists of the rows at hand; at most ``HELD`` pairs of them are kept at a time."""
    firsts: list[int] = []
    keys: list[np.ndarray] = []
    grams: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        by_key = sorted(range(len(keys)), key=firsts.__getitem__)
        key, gram = np.concatenate([keys[i] for i in by_key]), np.concatenate([grams[i] for i in by_key])
        order = np.argsort(gram, kind="stable")
        key, gram = key[order], gram[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))
        key, gram = key[new], gram[new]
        block = key // LIST
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
        ends = pa.array(np.append(first, len(key)), pa.int32())
        places = pa.ListArray.from_arrays(ends, pa.array(key - block * LIST, pa.int16()))
        for held in (firsts, keys, grams):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(block[first]), places], names=["gram", "block", "places"])

    n = 0
    for b in batches:
        for key, text in zip(b.column("key").to_numpy(), b.column("v")):
            own = _grams(_codes(text.as_py()))
            firsts.append(int(key))
            keys.append(np.full(len(own), key))
            grams.append(own)
            n += len(own)
            if n > HELD:
                yield told()
                n = 0
    if n:
        yield told()


def write_trigrams(docs: DataFrame, key: str, fields: dict[str, Column], path: str, per_bucket: int = 16_000_000) -> int:
    """Lists of keys by field and trigram, in as many buckets as the rows need; returns how many. ``fields``: texts or arrays of texts.

    Keys are numbers. A task writes the lists of its rows, for each ``LIST`` numbers apart, so none is long and no task has all of
    a trigram that most rows hold.
    """
    found = None
    for name, value in fields.items():
        kind = docs.select(value.alias("v")).schema["v"].dataType.typeName()
        each = docs.select(F.col(key).cast("long").alias("key"), (F.explode(value) if kind == "array" else value).alias("v")).filter("key IS NOT NULL AND length(v) > 2")
        rows = each.select("key", F.lower("v").alias("v")).mapInArrow(_lists, "gram long, block long, places array<short>").withColumn("field", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    lists = cut(found)
    buckets = max(1, -(-(lists.agg(F.sum(F.size("places"))).first()[0] or 0) // per_bucket))
    placed = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(16))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/lists")
    placed.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/size")
    return buckets


def candidates(spark: SparkSession, path: str, needle: str, fields: list[str]) -> DataFrame | None:
    """Keys whose field holds all trigrams of the needle; None if it has none."""
    grams = _grams(_codes(spark.range(1).select(F.lower(F.lit(needle))).first()[0])).tolist()
    if not grams:
        return None
    (buckets,) = spark.read.parquet(f"{path}/size").first()
    held = F.pmod(F.xxhash64("gram"), F.lit(buckets))
    places = {r.b for r in spark.createDataFrame([(g,) for g in grams], "gram long").select(held.cast("int").alias("b")).collect()}
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("bucket").isin(*sorted(places)) & F.col("gram").isin(*grams) & F.col("field").isin(*fields))
    # the lists of a field and block meet, and places are in all of them or go
    own = lists.groupBy("field", "block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    met = own.groupBy("field", "block").agg(F.count(F.lit(1)).alias("n"), F.collect_list("places").alias("lists")).filter(F.col("n") == len(grams))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return met.select(F.explode(both).alias("place"), "block").select((F.col("block") * LIST + F.col("place")).alias("key")).distinct()


def search_trigrams(docs: DataFrame, key: str, fields: dict[str, Column], path: str, needle: str) -> DataFrame:
    """Rows of ``docs`` of which any of the fields holds the needle, in either case. A needle of under three characters reads all rows."""
    found = candidates(docs.sparkSession, path, needle, list(fields))
    rows = docs if found is None else docs.join(found.withColumnRenamed("key", key), key, "left_semi")
    return rows.filter(_holds(docs, fields, needle))


def search_needles(docs: DataFrame, key: str, fields: dict[str, Column], path: str, needles: list[str]) -> DataFrame:
    """needle, key: what ``search_trigrams`` finds for each of the needles, by one pass over ``docs`` for all of them."""
    found = [candidates(docs.sparkSession, path, n, list(fields)) for n in needles]
    some = [f.select(F.col("key").alias("_key"), F.lit(i).alias("_i")) for i, f in enumerate(found) if f is not None]
    rows = docs.withColumn("_asked", F.lit(None).cast("array<int>"))
    if some:
        asked = reduce(DataFrame.unionByName, some).groupBy("_key").agg(F.collect_set("_i").alias("_asked"))
        rows = docs.join(asked, F.col(key) == F.col("_key"), "inner" if len(some) == len(needles) else "left")
    could = lambda i: F.lit(True) if found[i] is None else F.coalesce(F.array_contains("_asked", i), F.lit(False))
    hits = F.array(*(F.when(could(i) & _holds(docs, fields, n), F.lit(n)) for i, n in enumerate(needles)))
    return rows.select(F.explode(F.array_compact(hits)).alias("needle"), key)


def _holds(docs: DataFrame, fields: dict[str, Column], needle: str) -> Column:
    holds = lambda v: F.contains(F.lower(v), F.lower(F.lit(needle)))
    tests = [F.exists(v, holds) if docs.select(v.alias("v")).schema["v"].dataType.typeName() == "array" else holds(v) for v in fields.values()]
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))
