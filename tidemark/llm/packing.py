"""Operator 9: best-fit packing of tokenised documents with a swap-based local search.

Token ids come from a tokenizer file; a document is its ids and then id 0, and only documents longer than a
sequence are cut. Words are encoded once per Python worker and looked up afterwards; texts with characters outside
the plain set take the tokenizer's own way, so the ids are always its ids.

Pieces are dealt into groups of about ``GROUP`` at random; a full piece is a sequence by itself. Each group is packed by best
fit in falling length; then the search takes one or two documents out of an underfull sequence into any other of the
group and gives none, one or two back, whenever that increases the sum of squared fills, so that the emptiest sequences
run empty. It ends at the lower bound, or when no such step is left.

Defined cases: a null text is empty and takes one place (id 0); repeated rows are packed one by one; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SEQUENCE = 2048
GROUP = 4096
#: Words that a task remembers, and the bytes of them and their ids; then it forgets them.
CACHED_WORDS, CACHED_BYTES = 700_000, 64_000_000
#: Texts whose unknown words are encoded together.
BLOCK = 32

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = b"\0\0\0\0"
#: Texts of these characters need no normalisation but lower case, and split at plain white space only.
_PLAIN = re.compile(r"[\n\t\r -~À-ÖØ-öø-ÿ]*\Z")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Little-endian 32-bit ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        # words come cut and in lower case, one space between them
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        learned: dict[str, bytes] = {}
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.words.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                data = ids.tobytes()
                parts = [data[a:b] for a, b in zip([0, *stops], stops)]
            else:  # not one end per word: no use of the joined text
                parts = [np.array(e.ids, dtype="<u4").tobytes() for e in self.words.encode_batch(some, add_special_tokens=False)]
            learned.update(zip(some, parts))
        if len(self.known) > CACHED_WORDS or self.size > CACHED_BYTES:
            self.known.clear()
            self.size = 0
        self.known.update(learned)
        self.size += sum(len(w) + len(x) for w, x in learned.items())
        return learned

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), BLOCK):
            rows, fresh = [], set()
            for text in texts[at : at + BLOCK]:
                if "<|" in text or not _PLAIN.match(text):
                    rows.append((None, [np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]))
                    continue
                words = _WORDS.findall(text.lower())
                parts = list(map(self.known.get, words))
                if not all(parts):
                    fresh.update(w for w, p in zip(words, parts) if p is None)
                rows.append((words, parts))
            learned = self._learn(list(fresh)) if fresh else {}
            for words, parts in rows:
                if words is not None and not all(parts):
                    parts = [learned[w] if p is None else p for w, p in zip(words, parts)]
                yield b"".join(parts)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, limit: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += _END
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def best_fit(lengths: list[int], limit: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set if some bin has r places left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = rooms >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = limit, len(bins)
            bins.append([])
        bins[at].append(i)
        by_room[room - lengths[i]].append(at)
        rooms |= 1 << (room - lengths[i])
    return bins


def improve(bins: list[list[int]], lengths: list[int], limit: int = SEQUENCE) -> list[list[int]]:
    """Steps that take one or two items out of a bin and give none, one or two back, while the sum of squared fills grows.

    ``after[t, j]`` is the least room that bin j can end with when it takes items of length t in all and gives back
    less, or ``limit + 1``. A step out of bin k gains just if that is less than the room of k, so one row's least
    entry tells the best of all bins. The search ends at the lower bound, or when no bin has a gaining step.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    bound = -(-sum(fill) // limit)
    left = sum(f > 0 for f in fill)
    live = [k for k in range(len(bins)) if 0 < fill[k] < limit]
    if left <= bound or len(live) < 2:
        return [b for b in bins if b]
    held = [bins[k] for k in live]
    room = [limit - fill[k] for k in live]
    sums = [_sums(b, lengths) for b in held]
    columns = np.empty((len(live), limit + 1), dtype=np.min_scalar_type(limit + 1))
    for j in range(len(live)):
        columns[j] = _after(sums[j], room[j], limit)
    after = np.ascontiguousarray(columns.T)
    del columns
    stirred = True
    while stirred and left > bound:
        stirred = False
        for k in sorted(range(len(live)), key=lambda k: (-room[k], k)):
            while 0 < room[k] < limit and left > bound and (step := _step(k, sums[k], room[k], after)):
                stirred = True
                t, j = step
                out = _items(t, held[k], lengths)
                back = _items(t - (room[j] - int(after[t, j])), held[j], lengths)
                delta = t - sum(lengths[i] for i in back)
                held[k] = [x for x in held[k] if x not in out] + back
                held[j] = [x for x in held[j] if x not in back] + out
                room[k] += delta
                room[j] -= delta
                left -= room[k] == limit
                for x in (k, j):
                    sums[x] = _sums(held[x], lengths)
                    after[:, x] = _after(sums[x], room[x], limit)
    for k, b in zip(live, held):
        bins[k] = b
    return [b for b in bins if b]


def _sums(items: list[int], lengths: list[int]) -> list[int]:
    """All lengths of one or two of the items, the longest first."""
    once, twice = set(), set()
    for i in items:
        (twice if lengths[i] in once else once).add(lengths[i])
    some = sorted(once)
    return sorted(once | {2 * a for a in twice} | {a + b for x, a in enumerate(some) for b in some[:x]}, reverse=True)


def _after(sums: list[int], room: int, limit: int) -> np.ndarray:
    """Per length t the least room of a bin that takes t and gives back less, so that t fits; else limit + 1."""
    out = np.full(limit + 1, limit + 1)
    if room < limit:
        gives = np.array([0, *sums[::-1]])
        # the least gift of x or more, for each x
        least = np.repeat(gives, np.diff(gives, prepend=-1))
        t = np.arange(1, min(limit, len(least) - 1 + room) + 1)
        gift = least[np.maximum(t - room, 0)]
        out[t] = np.where(gift < t, room - t + gift, limit + 1)
    return out


def _step(k: int, sums: list[int], room: int, after: np.ndarray) -> tuple[int, int] | None:
    """A length that bin k gives away, the longest first, and the bin that ends fullest with it and fuller than k was."""
    for t in sums:
        row = after[t]
        own, row[k] = row[k], room
        j = int(row.argmin())
        gains = row[j] < room
        row[k] = own
        if gains:
            return t, j
    return None


def _items(total: int, items: list[int], lengths: list[int]) -> list[int]:
    """No item, one or two of that length in all."""
    if not total:
        return []
    seen: dict[int, int] = {}
    for i in items:
        if lengths[i] == total:
            return [i]
        seen.setdefault(lengths[i], i)
    for i in items:
        other = seen.get(total - lengths[i])
        if other is not None and other != i:
            return [i, other]
    raise ValueError(total)


def pack(parts: DataFrame, limit: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``; keeps their columns."""
    # row ids are fixed by the checkpoint, so a lost executor can't change them
    rows = cut(parts.withColumn("_row", F.monotonically_increasing_id()))
    short = rows.filter(F.col("length") < limit)
    groups = max(1, -(-short.count() // group))
    dealt = short.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int").alias("_group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        lengths, ids = pdf["length"].tolist(), pdf["_row"].tolist()
        out = []
        for b in improve(best_fit(lengths, limit), lengths, limit):
            at, name = 0, ids[min(b)]
            for i in b:
                out.append((ids[i], name, at))
                at += lengths[i]
        return pd.DataFrame(out, columns=["_row", "sequence_id", "offset"])

    placed = dealt.groupBy("_group").applyInPandas(run, "_row long, sequence_id long, offset long")
    full = rows.filter(F.col("length") >= limit).withColumn("sequence_id", F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    return rows.join(placed, "_row").unionByName(full).drop("_row")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(pieces(docs, path))
