"""Operator 12: alignment of two tokenizers' tokens by the bytes that they cover.

A (byte-level BPE) and B (BPE of pieces) see a space and the text. Neither has a token that holds white space after another
character, so a text falls apart into stretches (white space and what follows it up to the next white space) that both encode
alike wherever they stand. If a vocabulary does not allow that, a text is one stretch. Where tokens end together depends on
their byte lengths only, so every distinct pair of length sequences (the shape of a stretch) is aligned once, relationally: its
tokens are exploded with their positions, a window adds up their lengths, an equi-join on shape and end finds the cuts, and the
running number of cuts is the group. Stretches get the groups and links of their shape by a join. A pair of ids counts its links
in a stretch times the documents' occurrences of that stretch; up to ``PAIRS_SENT`` counts are sent to the links, more are joined.

Documents then look up their stretches. The ``FREQUENT`` most frequent short ones travel to all tasks, a table of bounded size;
all others are joined by the stretch and brought to the texts that hold them.

Defined cases: null and empty texts have no tokens, nor do texts that B does not give back byte for byte (such as those with
U+2581): zeros and '', and they count no pair; a text of white space has tokens; repeated rows count each time; one stretch may
be as long as its text; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.operators.lineage import forget, shared_folder

#: Stretches that every task gets: the most frequent ones that are no longer, nor their groups, than so many characters.
FREQUENT, SHORT = 400_000, 200
#: Shapes of stretches, with their groups, that are sent to all tasks.
SHAPES_SENT = 400_000
#: Pairs of ids, with their counts, that are sent to all tasks.
PAIRS_SENT = 4_000_000
#: Entries after which a task hands on what it has counted or forgets which texts it has seen.
HELD = 300_000
#: Bytes of documents that are told at once.
TOLD = 1_000_000
CUTS = " \n\t"
_CUT = re.compile(rf"(?<=\S)(?=[{CUTS}])")
#: White space that the plain way of splitting can't take: other than one space or line break between other characters.
_ODD = re.compile(r"[^\S \n]|[ \n](?:[ \n]|\Z)")
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_REPORT = "doc_id long, " + ", ".join(f"{x} long" for x in SUMS) + ", groups_sha256 string"


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers, over stretches. A stretch of one space and a word is named by the word, any other by itself."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.files = path_a, path_b
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_b = [len(x) for x in self.bytes_b]
        # a character of a byte-level token stands for one byte
        self.lengths_a = [len(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.space = self.b.piece_to_id("▁")
        self.most_ids = max(len(self.lengths_a), len(self.lengths_b))
        texts = [p.replace("▁", " ") for p in pieces]
        apart = not any(re.search(rf"\S[{CUTS}]", p) for p in texts) and not any(re.search(r"^ [\n\t]", p) for p in texts)
        self.cut = _CUT if apart else None

    def encode(self, names: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B."""
        whole = [n if n[:1].isspace() else f" {n}" for n in names]
        a = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        # B puts a space in front of what it gets; elsewhere that is a token of its own
        b = self.b.encode([s[1:] if s[0] == " " else s for s in whole], num_threads=1)
        return a, [(ids if s[0] == " " else ids[1:]) or [self.space] for s, ids in zip(whole, b)]

    def splitter(self) -> Splitter:
        return Splitter(self.cut is not None, None if not _normalises(self.b) else self.files)


@dataclass(frozen=True)
class Splitter:
    """How texts fall into stretches, without the tokenizers; ``files`` only where B changes characters, which only B can tell."""

    apart: bool
    files: tuple[str, str] | None

    def stretches(self, text: str) -> list[str]:
        if not self.apart:
            return [f" {text}"]
        if not _ODD.search(f" {text}"):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " and s[1:2].strip() else s for s in _CUT.split(f" {text}")]

    def lossless(self, text: str) -> bool:
        """Whether B gives back every byte. It does, but for its own sign of a space and what it normalises."""
        if "▁" in text:
            return False
        if self.files is None or text.isascii():
            return True
        b = _tokenizers(*self.files).b
        return b.decode(b.encode(text, num_threads=1)) == text


@lru_cache(maxsize=4)
def _normalises(b) -> bool:
    """Whether B changes characters before it encodes them; shown by those that usual rules change."""
    sample = "ﬁ ² ａ ｶ Å é   ​ ﻿   \u0001 x  y "
    return b.decode(b.encode(sample)) != sample


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def stretches(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """stretch, n: how often each stands in the texts that have tokens."""
    split = _tokenizers(*(files or paths())).splitter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                if text and split.lossless(text):
                    held.update(split.stretches(text))
                    if len(held) > HELD:
                        yield _counted(held)
                        held = Counter()
        yield _counted(held)

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "stretch string, n long")
    return rows.groupBy("stretch").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["stretch", "n"])


def encoded(found: DataFrame, files: tuple[str, str]) -> DataFrame:
    """stretch, n, a, b (ids of its tokens), shape (bytes of each token of A, a bar, of each token of B)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files)
        size_a, size_b = ([str(x) for x in sizes] for sizes in (both.lengths_a, both.lengths_b))
        for b in batches:
            ids = both.encode(b.column("stretch").to_pylist())
            shapes = [f"{','.join([size_a[i] for i in x])}|{','.join([size_b[i] for i in y])}" for x, y in zip(*ids)]
            lists = [pa.array(rows, pa.list_(pa.int32())) for rows in ids]
            yield pa.RecordBatch.from_arrays([b.column("stretch"), b.column("n"), *lists, pa.array(shapes, pa.string())], names=["stretch", "n", "a", "b", "shape"])

    return found.mapInArrow(run, "stretch string, n long, a array<int>, b array<int>, shape string")


def _ends(shapes: DataFrame, side: int, name: str) -> DataFrame:
    """shape, end (bytes up to the end of a token), and the number of tokens up to there."""
    sizes = F.split(F.element_at(F.split("shape", r"\|"), side), ",").cast("array<int>")
    exploded = shapes.select("shape", F.posexplode(sizes).alias("pos", "bytes"))
    end = F.sum("bytes").over(W.partitionBy("shape").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return exploded.select("shape", end.alias("end"), (F.col("pos") + 1).alias(name))


def cuts(shapes: DataFrame) -> DataFrame:
    """shape, stops_a, stops_b: for each group, in order, how many tokens of A and of B end with it."""
    met = _ends(shapes, 1, "a").join(_ends(shapes, 2, "b"), ["shape", "end"])
    group = F.row_number().over(W.partitionBy("shape").orderBy("end"))
    # as long as the stretch at most
    stops = F.array_sort(F.collect_list(F.struct("group", "a", "b")))
    every = met.withColumn("group", group).groupBy("shape").agg(stops.alias("g"))
    return every.select("shape", F.transform("g", lambda x: x["a"]).alias("stops_a"), F.transform("g", lambda x: x["b"]).alias("stops_b"))


def aligned(docs: DataFrame, files: tuple[str, str] | None = None, shapes_sent: int = SHAPES_SENT) -> DataFrame:
    """stretch, n, n_a, n_b, groups (text), link_a, link_b (ids by link): one row per distinct stretch, in a written table."""
    files = files or paths()
    tokens, there = _written(encoded(stretches(docs, files), files))
    found = cut(cuts(tokens.select("shape").distinct()))
    joined = tokens.join(F.broadcast(found) if found.count() <= shapes_sent else found, "shape")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.array([str(i) for i in range(_tokenizers(*files).most_ids)])
        for b in batches:
            if b.num_rows:
                sides = [_grouped(b.column(ids), b.column(stops), numbers) for ids, stops in (("a", "stops_a"), ("b", "stops_b"))]
                (said_a, link_a, n_a), (said_b, link_b, n_b) = sides
                said = pc.binary_join(pa.ListArray.from_arrays(link_a.offsets, pc.binary_join_element_wise(said_a, said_b, "|")), ";")
                yield pa.RecordBatch.from_arrays([b.column("stretch"), b.column("n"), n_a, n_b, said, link_a, link_b], names=["stretch", "n", "n_a", "n_b", "groups", "link_a", "link_b"])

    out, _ = _written(joined.mapInArrow(run, "stretch string, n long, n_a long, n_b long, groups string, link_a array<int>, link_b array<int>"))
    forget(docs.sparkSession, there)
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows behind one another, and where each row starts and the last one ends."""
    sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _grouped(ids: pa.ListArray, stops: pa.ListArray, numbers: pa.Array) -> tuple[pa.Array, pa.ListArray, pa.Array]:
    """For all groups of all rows what is said of their ids; each row's last ids of its groups; each row's number of ids."""
    (id_, first), (stop, at) = _flat(ids), _flat(stops)
    last = stop + np.repeat(first[:-1], np.diff(at))
    bounds = pa.array(np.concatenate([[0], last]).astype(np.int32))
    said = pc.binary_join(pa.ListArray.from_arrays(bounds, numbers.take(pa.array(id_))), ",")
    return said, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(id_[last - 1])), pa.array(np.diff(first))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it is."""
    path = f"{shared_folder(df.sparkSession)}/alignment-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def links(found: DataFrame) -> DataFrame:
    """a, b, n_linked (links of the pair in all documents), is_best (no pair of that b has more), from ``aligned``."""
    each = found.select("n", F.explode(F.arrays_zip("link_a", "link_b")).alias("link"))
    pairs = each.groupBy(F.col("link.link_a").alias("a"), F.col("link.link_b").alias("b")).agg(F.sum("n").alias("n_linked"))
    most = pairs.groupBy("b").agg(F.max("n_linked").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n_linked", (F.col("n_linked") == F.col("most")).alias("is_best"))


def summed(found: DataFrame, pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """stretch, n, the ``SUMS`` and groups of each distinct stretch. Up to ``pairs_sent`` pairs of ids travel; more are joined."""
    size = F.size("link_a").cast("long")
    own = [F.col("stretch"), F.col("n"), F.col("n_a"), F.col("n_b"), size.alias("n_groups"), size.alias("n_links")]
    pairs = cut(links(found))
    if pairs.count() > pairs_sent:
        each = found.select("stretch", F.explode(F.arrays_zip("link_a", "link_b")).alias("link")).select("stretch", F.col("link.link_a").alias("a"), F.col("link.link_b").alias("b"))
        told = each.join(pairs, ["a", "b"]).groupBy("stretch").agg(F.sum(F.col("is_best").cast("long")).alias("n_best"), F.sum("n_linked").alias("count_sum"))
        return found.select(*own, "groups").join(told, "stretch").select("stretch", "n", *SUMS, "groups")
    table = pairs.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n_linked", "is_best").toArrow().sort_by("pair")
    shared = found.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n_linked", "is_best")])

    @F.arrow_udf("struct<n_best:long,count_sum:long>")
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        pair, n_linked, is_best = shared.value
        sizes = np.diff(a.offsets.to_numpy())
        at = np.searchsorted(pair, (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        # no stretch is without a link, so no sum is empty; sums stay whole numbers
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        add = lambda x: np.add.reduceat(x[at].astype(np.int64), starts) if len(at) else np.empty(0, dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(add(is_best)), pa.array(add(n_linked))], names=["n_best", "count_sum"])

    told = found.select(*own, "groups", counted("link_a", "link_b").alias("t"))
    return told.select("stretch", "n", "n_a", "n_b", "n_groups", "n_links", "t.n_best", "t.count_sum", "groups")


def _least_count(told: DataFrame, frequent: int) -> int:
    """The count from which on stretches are among the ``frequent`` most frequent ones, all of that count included."""
    most = 10_000
    counts = {r.n: r.c for r in told.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    held, least = 0, most + 1
    for n in sorted(counts, reverse=True):
        held += counts[n]
        if held > frequent:
            break
        least = n
    return least


class Known:
    """What is told of some stretches, in flat arrays that are not copied: a worker holds about a hundred bytes for each."""

    def __init__(self, stretch: pa.Array, values: np.ndarray, groups: pa.Array):
        # tasks of a worker share the hashes, which need not be the same elsewhere
        self.hashes, self.first = np.unique(hashed(stretch.to_pylist()), return_index=True)
        self.values, self.groups = values, groups

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the stretches, -1 for those that aren't known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.first[at], -1)


def _values(columns, n: int) -> np.ndarray:
    return np.stack([columns[x].to_numpy() if isinstance(columns[x], pa.ChunkedArray) else columns[x].to_numpy(zero_copy_only=False) for x in SUMS], axis=1) if n else np.empty((0, len(SUMS)), dtype=np.int64)


def hashed(stretches: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, stretches), dtype=np.int64, count=len(stretches))


_KNOWN: dict[int, Known] = {}


def _known(shared) -> Known:
    """One table for a worker, made when its first task wants it."""
    if shared.value[0] not in _KNOWN:
        _KNOWN.clear()
        _tokenizers.cache_clear()  # the worker has done with them
        _KNOWN[shared.value[0]] = Known(*shared.value[1:])
    return _KNOWN[shared.value[0]]


def report(docs: DataFrame, files: tuple[str, str] | None = None, frequent: int = FREQUENT, pairs_sent: int = PAIRS_SENT, shapes_sent: int = SHAPES_SENT) -> DataFrame:
    """doc_id, the ``SUMS``, groups_sha256: one row per row of ``docs``."""
    files = files or paths()
    split = _tokenizers(*files).splitter()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    told = summed(aligned(docs, files, shapes_sent), pairs_sent)
    short = (F.char_length("stretch") <= SHORT) & (F.char_length("groups") <= SHORT)
    is_frequent = short & (F.col("n") >= _least_count(told.filter(short).select("n"), frequent))
    # a table of bounded size
    table = told.filter(is_frequent).select("stretch", *SUMS, "groups").toArrow()
    whole = lambda c: pa.concat_arrays(table.column(c).chunks) if len(table) else pa.array([], pa.string())
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().int, whole("stretch"), _values(table, len(table)), whole("groups")))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _known(shared), set()
        for b in batches:
            keys, words = [], []
            for text, key in zip(b.column("text").to_pylist(), b.column("text_key").to_pylist()):
                if not text or key in seen or not split.lossless(text):
                    continue
                seen.add(key)
                found = split.stretches(text)
                own = {found[k] for k in np.flatnonzero(known.find(hashed(found)) < 0).tolist()}
                keys += [key] * len(own)
                words += own
            if len(seen) > HELD:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["text_key", "stretch"])

    others = rows.select("text", "text_key").mapInArrow(rare, "text_key long, stretch string").join(told.filter(~is_frequent).drop("n"), "stretch")
    # texts that share a key share the list: it is only looked up in
    brought = others.groupBy("text_key").agg(F.collect_set(F.struct("stretch", *SUMS, "groups")).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared)
        for whole in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0))
            starts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // TOLD, prepend=-1)).tolist()
            for start, stop in zip(starts, [*starts[1:], whole.num_rows]):
                b = whole.slice(start, stop - start)
                brought = b.column("others").flatten()
                more = Known(brought.field("stretch"), _values(dict(zip(SUMS, map(brought.field, SUMS))), len(brought)), brought.field("groups"))
                found, sizes = [], []
                for text in b.column("text").to_pylist():
                    own = split.stretches(text) if text and split.lossless(text) else []
                    found += own
                    sizes.append(len(own))
                hashes = hashed(found)
                at = known.find(hashes)
                missed = at < 0
                at[missed] = len(known.values) + more.find(hashes[missed])
                values = np.empty((len(at), len(SUMS)), dtype=np.int64)
                values[~missed], values[missed] = known.values[at[~missed]], more.values[at[missed] - len(known.values)]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = np.concatenate([np.zeros((1, len(SUMS)), dtype=np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
                sums = sums[ends[1:]] - sums[ends[:-1]]
                groups = pa.concat_arrays([known.groups.take(pa.array(at[~missed])), more.groups.take(pa.array(at[missed] - len(known.values)))])
                order = np.empty(len(at), dtype=np.int64)
                order[~missed], order[missed] = np.arange((~missed).sum()), (~missed).sum() + np.arange(missed.sum())
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), groups.take(pa.array(order))), ";")
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(joined, sizes)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in sums.T), pa.array(digests, pa.string())], names=["doc_id", *SUMS, "groups_sha256"])

    return rows.join(brought, "text_key", "left").select("doc_id", "text", "others").mapInArrow(run, _REPORT)
