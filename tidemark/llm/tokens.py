"""Operator 10: token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the dynamic programme carries only
the best score and its number of pieces. Ties go as in the exact tokenizer: among equal scores the piece that starts
first (the longest) stays, a character that no piece covers is unknown at the lowest score less 10, and unknown
characters in a row are one piece. Words are marked in front and never share a piece, so a word is counted once per Python worker.

The vocabulary is that of the file ``path``; a piece of rank r scores -ln(r + 2). Words are split at white space.

Defined cases: null and empty texts have no tokens; repeated rows count alike; very long words run in linear time and
aren't kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 1_000_000
CACHED_LENGTH = 64
#: Characters of the rows whose new words are counted together.
BLOCK = 4_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces that stand for text, in the order of the file, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [(p, -math.log(rank + 2)) for rank, p in enumerate(plain)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        """Pieces of the best path through each marked word, for words in order: what a word shares with the one before
        it in front is not worked out again.

        The automaton tells the matches of one end together, the longest first, which is the order of the tie rule.
        """
        low, matches = self.unknown, self.matches
        best, pieces, loose = [0.0], [0], [False]  # best score, pieces, "ends in unknown" up to each character
        out, before = [], ""
        for w in words:
            text = MARK + w
            n, keep = len(text), 0
            for a, b in zip(text, before):
                if a != b:
                    break
                keep += 1
            before = text
            best[keep + 1 :] = pieces[keep + 1 :] = loose[keep + 1 :] = [0] * (n - keep)
            at, top, number, single = keep + 1, -math.inf, 0, False
            for last, (length, score) in [m for m in matches.iter(text) if m[0] >= keep]:
                while at <= last:  # no more matches end here
                    if not single and best[at - 1] + low > top:
                        top, number, loose[at] = best[at - 1] + low, pieces[at - 1] + (not loose[at - 1]), True
                    best[at], pieces[at] = top, number
                    at, top, number, single = at + 1, -math.inf, 0, False
                x = best[at - length] + score
                if x > top:
                    top, number = x, pieces[at - length] + 1
                if length == 1:
                    single = True
            while at <= n:
                if not single and best[at - 1] + low > top:
                    top, number, loose[at] = best[at - 1] + low, pieces[at - 1] + (not loose[at - 1]), True
                best[at], pieces[at] = top, number
                at, top, number, single = at + 1, -math.inf, 0, False
            out.append(pieces[n])
        return out

    def __call__(self, rows: list[list[str]]) -> list[int]:
        """Pieces of each row of words."""
        known = self.known
        if len(known) >= CACHED_WORDS:
            known.clear()
        found = [list(map(known.get, words)) for words in rows]
        new = sorted({w for words, ns in zip(rows, found) if None in ns for w, n in zip(words, ns) if n is None})
        learned = dict(zip(new, self.counts(new)))
        known.update((w, n) for w, n in learned.items() if len(w) <= CACHED_LENGTH)
        return [sum(ns) if None not in ns else sum([learned[w] if n is None else n for w, n in zip(words, ns)]) for words, ns in zip(rows, found)]


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points), n_words, n_tokens: one row per input row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n_words, n_tokens, waiting, held = [], [], [], 0
            for t in [*texts, None]:
                if waiting and (t is None or held + len(t) > BLOCK):
                    n_words += map(len, waiting)
                    n_tokens += counter(waiting)
                    waiting, held = [], 0
                if t is not None:
                    waiting.append(t.split())
                    held += len(t)
            rows = [list(map(len, texts)), n_words, n_tokens]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(r, pa.int64()) for r in rows)], names=["doc_id", "n_chars", "n_words", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_chars long, n_words long, n_tokens long"
    )
