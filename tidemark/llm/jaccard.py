"""Operator 13: a self-join of documents by the Jaccard similarity of their 4-word shingles, by PartEnum signatures.

Two sets of sizes a <= b are at least 85 % alike only if b <= a / 0.85 and they differ in at most 15 (a + b) / 185 members.
Sizes fall into bands that grow by ``GROWTH``; a set has signatures under its own band, and under the one below if a set of
that band can be like it. A band deals the domain (64-bit hashes, by their order) into parts, more than half as many as a pair
may differ in, so in some part the two differ by one member at most. Each part has three thirds, and its three signatures leave
out one third each: one of them is the same in both sets.

A signature of fewer than ``WEAK`` members says little. There are spare parts, so a set leaves such signatures out if at every
smaller size that a partner may have, more parts agree than it has weak ones. A set with too many weak parts has them in
combination with each of its signatures under a second dealing, which a partner has, too. No pair within the bound is lost.

Copies (sets of one hash) are one class before the search. Signatures are grouped within a task first, then by ranges: a
group gives a star, not its pairs. The components of the stars are compared exactly: each is dealt into blocks of bounded size,
and a task has a pair of blocks and searches breadth-first with lists of members, so only trees leave it.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; fewer than four words are one shingle;
white space is ASCII; repeated rows are copies; a null doc_id never names a component that has another id; an empty table gives
no rows; other columns are ignored. Shingles, sets and texts are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import cut, utf8
from tidemark.llm.simhash import SHARE, components

WIDTH = 4
#: Linked: LIKE * union <= OF * intersection.
LIKE, OF = 85, 100
GROWTH = 1.3
WEAK = 2
#: Signatures that a task groups before it hands them on, and those of a range.
HELD, RANGE = 1_500_000, 2_000_000
#: Members of all sets of a block.
BLOCK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64())])


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = set(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts)))


def set_key(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes())


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, key (hash of the set, null if it is empty): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t) for t in b.column("text").to_pylist()]
            keys = np.array([set_key(s) for s in found], dtype=np.uint64).view(np.int64)
            empty = np.array([not len(s) for s in found], dtype=bool)
            columns = [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, mask=empty)]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return _rows(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, key long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))


# signatures


def most_apart(a):
    """Members that a set of size ``a`` and a linked one that is no smaller may differ in."""
    return (OF - LIKE) * (a + OF * a // LIKE) // (OF + LIKE)


def parts_for(a):
    """Parts that a set of size ``a`` takes part in: one more than can differ by two members, and a quarter to spare."""
    needed = most_apart(a) // 2 + 1
    return needed + needed // 4


@lru_cache(maxsize=1)
def bands() -> list[int]:
    """Least sizes of the bands."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, int(found[-1] * GROWTH)))
    return found


@lru_cache(maxsize=4096)
def _edges(parts: int) -> np.ndarray:
    """Least hashes of all thirds but the first."""
    return np.array([(k << 64) // (3 * parts) for k in range(1, 3 * parts)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _dealt(members: np.ndarray, parts: int, taken: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the first parts, three each, and how many members each has. ``members`` are sorted."""
    stops = np.concatenate([[0], np.searchsorted(members, _edges(parts)[: 3 * taken]), [len(members)]])[: 3 * taken + 1]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(members), dtype=np.uint64)])[stops]
    third, count = np.diff(sums).reshape(taken, 3), np.diff(stops).reshape(taken, 3)
    name = np.arange(3 * taken, dtype=np.uint64).reshape(taken, 3) + (np.uint64(salt) << np.uint64(32))
    left = third.sum(axis=1, dtype=np.uint64)[:, None] - third
    return _mix(left + _mix(name + np.uint64(1))), count.sum(axis=1)[:, None] - count


def signatures(members: np.ndarray) -> np.ndarray:
    n = len(members)
    if n == 0 or most_apart(n) == 0:
        return np.empty(0, dtype=np.uint64)  # only copies are that much alike
    low = bands()
    own = int(np.searchsorted(low, n, side="right")) - 1
    found = []
    for band in (own - 1, own):
        if band < 0 or band < own and OF * (low[own] - 1) < LIKE * n:
            continue
        most = low[band + 1] - 1
        parts = int(parts_for(most))
        taken = min(parts, int(parts_for(n)))
        sig, count = _dealt(members, parts, taken, band)
        weak = (count < WEAK).any(axis=1)
        sizes = np.arange(max(low[band], -(-LIKE * n // OF)), min(n, most) + 1)
        at = parts_for(sizes)
        spare = at - most_apart(sizes) // 2 - 1
        strong = count >= WEAK
        found.append(sig[strong])
        if (np.cumsum(weak)[at - 1] > spare).any():
            again, _ = _dealt(np.sort(_mix(members + np.uint64(band + 1))), parts, taken, band + 4096)
            found.append(_mix(sig[~strong][:, None] * np.uint64(3) + again.ravel()).ravel())
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (key, least key of its signature), distinct; and the places of the least keys."""
    order = np.lexsort((key, sig))
    s, k = sig[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, dtype=np.int64)
    hub = np.repeat(k[starts], np.diff(np.append(starts, len(s))))
    apart = k != hub
    edges = np.unique(np.stack([k[apart], hub[apart]], axis=1), axis=0) if apart.any() else np.empty((0, 2), dtype=np.int64)
    return edges[:, 0], edges[:, 1], order[starts]


def stars(docs: DataFrame, n_shingles: int) -> DataFrame:
    """u, v: edges between set keys whose components hold all linked pairs. ``n_shingles``: of all rows, for the number of ranges."""
    ranges = max(1, n_shingles // (2 * RANGE))

    def pack(sig: list[np.ndarray], key: list[int]) -> pa.RecordBatch:
        keys = np.repeat(np.array(key, dtype=np.int64), [len(s) for s in sig])
        sig_ = np.concatenate(sig)
        u, v, first = _stars(sig_, keys)
        sig_, keys = sig_[first], keys[first]  # in order
        at = (((sig_ >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        where = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(where[1:], len(at))
        rows = [(int(at[a]), sig_[a:b].tobytes(), keys[a:b].tobytes()) for a, b in zip(where, ends)]
        u_v = np.stack([u, v], axis=1).tobytes()
        columns = list(zip(*rows)) or [(), (), ()]
        edges = [u_v if i == 0 else b"" for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(edges, pa.binary())], names=["range", "sig", "key", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key, held, seen = [], [], 0, set()
        for b in batches:
            for text in b.column("text").to_pylist():
                members = shingle_set(text)
                own = set_key(members)
                if own in seen:
                    continue
                seen.add(own)
                sig.append(signatures(members))
                key.append(own - (1 << 64) if own >> 63 else own)
                held += len(sig[-1])
                if held > HELD:
                    yield pack(sig, key)
                    sig, key, held = [], [], 0
            if len(seen) > HELD:
                seen.clear()
        if held:
            yield pack(sig, key)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
        u, v, _ = _stars(joined("sig", np.uint64), joined("key", np.int64))
        local = joined("edges", np.int64).reshape(-1, 2)
        return pa.table({"u": np.concatenate([u, local[:, 0]]), "v": np.concatenate([v, local[:, 1]])})

    packed = docs.select(F.col("text").cast("string")).mapInArrow(run, "range long, sig binary, key binary, edges binary")
    return packed.groupBy("range").applyInArrow(lambda key, table: meet(key, table), "u long, v long").distinct()


# exact comparison


def linked_sizes(a, b, common):
    return OF * common >= LIKE * (a + b - common)


def trees(keys: list[int], members: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of trees that span the components of all linked pairs."""
    n = len(keys)
    sizes = np.array([len(m) for m in members])
    if n == 2:
        same = len(np.intersect1d(members[0], members[1], assume_unique=True))
        return [(keys[1], keys[0])] if linked_sizes(sizes[0], sizes[1], same) else []
    owner = np.repeat(np.arange(n), sizes)
    _, name = np.unique(np.concatenate(members), return_inverse=True)
    order = np.argsort(name, kind="stable")
    holders = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(name))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    length = np.diff(starts)
    # those whose members are held most come first: they link most
    fame = np.add.reduceat(length[name], first[:-1])
    seen, out = np.zeros(n, dtype=bool), []
    for i in np.argsort(-fame, kind="stable").tolist():
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            j = todo.pop()
            own = name[first[j] : first[j + 1]]
            own = own[length[own] > 1]
            some = length[own]
            at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum()) if len(own) else own
            common = np.bincount(holders[at], minlength=n)
            near = np.flatnonzero(linked_sizes(sizes[j], sizes, common) & ~seen)
            seen[near] = True
            todo += near.tolist()
            out += [(keys[k], keys[j]) for k in near.tolist()]
        if seen.all():
            break
    return out


def exact(docs: DataFrame, wanted: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """a, b: links that span the components, within each root of ``wanted`` (key, root, n_shingles)."""
    total = wanted.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    placed = wanted.join(total, "root").withColumn("blocks", F.ceil(F.col("total") / block)).withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    # every pair of blocks, also a block with itself if there is one only
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.transform(other, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j")))).otherwise(F.filter(pairs, lambda p: p["i"] != p["j"]))
    placed = placed.select("key", "root", F.explode(pairs).alias("pair")).select("key", "root", "pair.i", "pair.j")
    maybe = bloom.column(docs, wanted.select("text_key").withColumnRenamed("text_key", "key"), n, F.col("text_key"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t) for t in b.column("text").to_pylist()]
            keys = np.array([set_key(s) for s in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "members"])

    rows = _rows(docs).select("text_key", "text").filter(maybe)
    held = rows.join(wanted.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text").mapInArrow(members, "key long, members binary")
    dealt = held.join(placed, "key").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, own = None, [], []

        def close() -> list[tuple[int, int]]:
            return trees(keys, own) if len(keys) > 1 else []

        for b in batches:
            out = []
            for root, i, j, key, data in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "key", "members"))):
                if (root, i, j) != at:
                    out += close()
                    at, keys, own = (root, i, j), [], []
                if not keys or keys[-1] != key:  # texts of one set
                    keys.append(key)
                    own.append(np.frombuffer(data, dtype=np.uint64))
            yield _edges_of(out)
        yield _edges_of(close())

    return dealt.select("root", "i", "j", "key", "members").mapInArrow(run, "a long, b long")


def _edges_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def linked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, key, root (key of the component), component_id: one row per input row."""
    rows = cut(sets(docs))
    by_key = rows.filter("key IS NOT NULL").groupBy("key")
    groups = cut(by_key.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles")))
    shingles, n_rows = rows.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    near = components(stars(docs, shingles or 0).toDF("a", "b")).withColumnRenamed("fp", "key")
    wanted = cut(groups.join(near, "key").select("key", "root", "text_key", "n_shingles"))
    classes = components(exact(docs, wanted, wanted.count(), block)).withColumnRenamed("fp", "key")
    named = groups.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by = named.select("key", "root", "n").join(least, "root")
    often = F.col("n") > SHARE * n_rows  # fewer than 1 / SHARE sets
    heavy, light = by.filter(often).drop("n"), by.filter(~often).drop("n")
    hot = F.broadcast(groups.filter(often).select("key"))
    full = rows.filter("key IS NOT NULL")
    empty = rows.filter("key IS NULL").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return full.join(F.broadcast(heavy), "key").unionByName(full.join(hot, "key", "left_anti").join(light, "key")).unionByName(empty)


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return linked(docs, block).select("doc_id", "n_shingles", "component_id")
