"""Lexical search for whole sets of questions, in which no pair of a question and a document leaves its task.

Words become hashes and counts once, in a table of their own; what all documents say of the asked terms is summed from it. Then
questions travel in blocks of bounded size, and tasks score their documents where they stand and keep the best ``k`` for each
question. The k-th best score so far is a question's threshold.

For many questions, terms that a good part of both sides hold are a matrix product in single precision, the others are added term
by term; whatever could pass the threshold within the error of that is scored again in double precision. For few questions, terms
whose gains can't reach the threshold even together are left out of the search for candidates (MaxScore), and only candidates
are scored in full. What is left out can't be among the best, so results are those of the exhaustive sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut, shared_folder
from tidemark.operators.retrieval import K1, B, word_list

#: Pairs of question and term that travel together; documents that are scored at once.
ASKED, ROWS = 1_000_000, 512
#: Scores are told apart down to so many digits; the margin is for sums in another order.
DIGITS, MARGIN = 6, 1e-5
#: Questions from which on a matrix product pays; the shares of documents and of questions that hold a term, multiplied, from which on
#: it is part of the product; the most terms in it.
MANY, COMMON, MOST_COMMON = 64, 1.5e-3, 2048
#: Single precision: the largest error of one operation, relative.
SINGLE = float(np.finfo(np.float32).eps)


def _terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, len, terms (distinct hashes of the words), counts. A row without a text has no len; rows without a key are no documents."""
    hashes = F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w))
    rows = docs.select(F.col(key).cast("long").alias("key"), hashes.alias("all")).filter("key IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            words = b.column("all")
            length = np.asarray(words.value_lengths().fill_null(0))
            row, flat = np.repeat(np.arange(len(words)), length), words.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((flat, row))
            row, flat = row[order], flat[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (flat[1:] != flat[:-1]))[: len(flat)])
            ends = pa.array(np.searchsorted(row[first], np.arange(len(words) + 1)), pa.int32())
            counts = np.diff(np.append(first, len(flat)))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((flat[first], pa.int64()), (counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), words.value_lengths().cast(pa.int32()), *lists], names=["key", "len", "terms", "counts"])

    return rows.mapInArrow(run, "key long, len int, terms array<long>, counts array<int>")


def _held(b: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place in ``wanted`` and count of each wanted term in each row; then the rows' lengths."""
    terms = b.column("terms")
    flat, count = terms.flatten().to_numpy(zero_copy_only=False), b.column("counts").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(terms)), np.asarray(terms.value_lengths()))
    at = np.minimum(np.searchsorted(wanted, flat), max(0, len(wanted) - 1))
    hit = wanted[at] == flat if len(wanted) else np.zeros(len(flat), dtype=bool)
    return row[hit], at[hit], count[hit], np.asarray(b.column("len").fill_null(0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class Search:
    """Running best ``k`` of each question over the documents that are shown to it.

    ``question`` and ``term`` are numbers, one pair for each term of a question, sorted by term. ``held``: the share of all
    documents that hold a term; without it there is no matrix product.
    """

    def __init__(self, question: np.ndarray, term: np.ndarray, idf: np.ndarray, bound: np.ndarray, n_questions: int, k: int, average: float, held: np.ndarray | None = None):
        self.q, self.t, self.idf, self.n, self.k, self.average = question, term, idf, n_questions, k, average
        # what a term and all weaker ones of its question can give together
        order = np.lexsort((bound[term], question))
        sums = np.cumsum(bound[term][order])
        first = np.searchsorted(question[order], np.arange(n_questions))
        before = np.concatenate([[0.0], sums])[first]
        self.reach = np.empty(len(term))
        self.reach[order] = sums - before[question[order]]
        self.scores = np.full((n_questions, k), -np.inf)
        self.names = np.zeros((n_questions, k), dtype=np.int64)
        self.threshold = np.full(n_questions, -np.inf)
        self.met = 0
        self.product = held is not None and n_questions >= MANY
        if self.product:
            shares = held * np.bincount(term, minlength=len(idf)) / n_questions
            some = np.argsort(-shares, kind="stable")[: min(MOST_COMMON, int((shares >= COMMON).sum()))]
            self.place = np.full(len(idf), -1)
            self.place[some] = np.arange(len(some))
            common = self.place[term] >= 0
            self.holds = np.zeros((n_questions, len(some)), dtype=np.float32)
            self.holds[question[common], self.place[term[common]]] = 1
            self.rest = np.flatnonzero(~common)
            self.many, self.start, self.asked = self._index(self.rest)

    @property
    def best(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(s[s > -np.inf], n[s > -np.inf]) for s, n in zip(self.scores, self.names)]

    def _index(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many questions of the pairs hold a term, where they begin, and the questions by term."""
        many = np.bincount(self.t[pairs], minlength=len(self.idf))
        return many, np.cumsum(many) - many, self.q[pairs]

    def _cells(self, index: tuple[np.ndarray, ...], row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each held term and each question that has it: the number of the held term, and the cell of row and question."""
        many, start, asked = index
        times = many[at]
        source = np.repeat(np.arange(len(at)), times)
        pair = np.arange(len(source)) + np.repeat(start[at] - np.cumsum(times) + times, times)
        self.met += len(source)
        return source, np.repeat(row * self.n, times) + asked[pair]

    def _add(self, pairs: np.ndarray, row: np.ndarray, at: np.ndarray, gain: np.ndarray, n_rows: int, only: np.ndarray | None) -> np.ndarray:
        """Sums of gains by row and question over some of the pairs; ``only``: the cells that matter."""
        source, cell = self._cells(self._index(pairs), row, at)
        if only is not None:
            keep = only.ravel()[cell]
            source, cell = source[keep], cell[keep]
        return np.bincount(cell, gain[source], minlength=n_rows * self.n).reshape(n_rows, self.n)

    def show(self, keys: np.ndarray, row: np.ndarray, at: np.ndarray, count: np.ndarray, length: np.ndarray) -> None:
        gain = self.idf[at] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[row] / self.average))
        rows, asked, score = (self._by_product if self.product else self._by_terms)(row, at, gain, len(keys))
        if not len(rows):
            return
        # the best so far of the questions that gain a candidate, and the candidates, by question
        some, number = np.unique(asked, return_inverse=True)
        old = np.isfinite(self.scores[some])
        s = np.concatenate([self.scores[some][old], score])
        names = np.concatenate([self.names[some][old], keys[rows]])
        number = np.concatenate([np.nonzero(old)[0], number])
        order = np.lexsort((names, -s.round(DIGITS), number))
        s, names, number = s[order], names[order], number[order]
        rank = np.arange(len(number)) - np.searchsorted(number, np.arange(len(some)))[number]
        top = rank < self.k
        self.scores[some[number[top]], rank[top]], self.names[some[number[top]], rank[top]] = s[top], names[top]
        self.threshold[some] = self.scores[some, self.k - 1]

    def _by_terms(self, row: np.ndarray, at: np.ndarray, gain: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, question and score of what may be among the best."""
        weak = self.reach < self.threshold[self.q] - MARGIN
        score = self._add(np.flatnonzero(~weak), row, at, gain, n_rows, None)
        candidate = score > 0
        if weak.any():
            rest = np.zeros(self.n)
            np.maximum.at(rest, self.q[weak], self.reach[weak])
            candidate &= score + rest >= self.threshold - MARGIN
            rows, asked = candidate.any(axis=1), candidate.any(axis=0)
            some = rows[row]
            score += self._add(np.flatnonzero(weak & asked[self.q]), row[some], at[some], gain[some], n_rows, candidate)
        rows, asked = np.nonzero(candidate)
        return rows, asked, score[rows, asked]

    def _by_product(self, row: np.ndarray, at: np.ndarray, gain: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        common = self.place[at] >= 0
        n_common = self.holds.shape[1]
        weight = np.zeros((n_rows, n_common))
        weight[row[common], self.place[at[common]]] = gain[common]
        left = ~common & (self.many[at] > 0)
        source, cell = self._cells((self.many, self.start, self.asked), row[left], at[left])
        others = np.bincount(cell, gain[left][source], minlength=n_rows * self.n).reshape(n_rows, self.n)
        rough = weight.astype(np.float32) @ self.holds.T
        rough += others  # rounded to single precision
        # all gains are positive, so a sum is off by a share of itself at most for each of its operations
        off = 1 - (n_common + 4) * SINGLE
        least = self.threshold * off - MARGIN
        if n_rows > self.k:  # what is behind the k-th best of these rows alone is no candidate either
            open_ = np.flatnonzero((rough >= least.astype(np.float32)).sum(axis=0) > self.k)
            part = np.partition(rough[:, open_], n_rows - self.k, axis=0)[n_rows - self.k]
            least[open_] = np.maximum(least[open_], part * off**2 - MARGIN)
        rows, asked = np.nonzero((rough >= least.astype(np.float32)) & (rough > 0))
        score = others[rows, asked]
        step = max(1, 1_000_000 // max(1, n_common))
        for a in range(0, len(rows), step):
            score[a : a + step] += np.einsum("ij,ij->i", weight[rows[a : a + step]], self.holds[asked[a : a + step]])
        return rows, asked, score


def bm25_batch(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, block: int = ASKED) -> DataFrame:
    """query_id, key, score, rank: the best ``k`` documents for each question of (query_id, term); ties by key.

    Scores that agree to ``DIGITS`` are ties. A question whose terms stand nowhere has no rows, nor have empty tables.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    _terms(docs, key, text).write.parquet(path)
    rows = spark.read.parquet(path)
    pairs = queries.select(F.col("query_id").cast("long"), F.xxhash64(F.lower("term")).alias("term")).filter("query_id IS NOT NULL").distinct()
    n, average = rows.agg(F.count(F.lit(1)), F.avg("len")).first()
    each = rows.select("len", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"), "len")
    # a count of at most ``most`` in a text of which it makes up ``share`` at most
    told = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"), F.max(F.col("tf") / F.col("len")).alias("share"))
    asked = cut(pairs.join(told, "term"))
    n_blocks = max(1, -(-asked.count() // block))
    deal = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    found = None
    for number in range(n_blocks):
        some = asked.filter(deal == number).toArrow()
        ids, question = np.unique(some.column("query_id").to_numpy(), return_inverse=True)
        wanted, one, term = np.unique(some.column("term").to_numpy(), return_index=True, return_inverse=True)
        df, most, share = (some.column(c).to_numpy()[one] for c in ("df", "most", "share"))
        idf = np.maximum(1e-6, np.log((n - df + 0.5) / (df + 0.5)))
        bound = idf * (K1 + 1) / (1 + K1 * (1 - B) / most + K1 * B / (share * (average or 1.0)))
        order = np.lexsort((question, term))
        shared = spark.sparkContext.broadcast((ids, wanted, question[order], term[order], idf, bound, average or 1.0, df / max(1, n)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wanted, question, term, idf, bound, average, held = shared.value
            search = Search(question, term, idf, bound, len(ids), k, average, held)
            for b in _chunks(batches):
                row, at, count, length = _held(b, wanted)
                if len(row):
                    search.show(b.column("key").to_numpy(), row, at, count, length)
            best = search.best
            columns = [np.repeat(ids, [len(s) for s, _ in best])] + [np.concatenate([x[i] for x in best] or [np.empty(0)]) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", key, "score"])

        part = rows.select("key", "len", "terms", "counts").mapInArrow(run, f"query_id long, {key} long, score double")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
