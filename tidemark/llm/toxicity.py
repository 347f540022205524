"""Operator 6: toxicity by weak supervision.

1. Terms are mined from a bounded sample of labelled training rows: words, stems (first four and five letters), and
   stems that two or more different words of a document share; all that are found far more often in toxic documents.
2. Voters: the mined terms dealt into lexicon voters by strength, one fixed word list per language, and voters on patterns of the
   text (stems, several terms, density, repetition, shouting, absence). Each votes toxic (1), clean (-1) or abstains (0).
3. A generative label model: votes of all documents are counted by pattern; expectation-maximisation, started from the
   labelled rows, estimates what each voter does on toxic and on clean texts. Correlations of the voters given the
   class, from the same table, temper the weight of voters that repeat each other. Labels only fix what the two classes
   mean: the posterior of a document comes from its votes.
4. A linear (logistic) classifier is trained on those posteriors, over a draw of all documents, and scores every one.

One pass makes votes and features of all documents, a few numbers each; what follows reads those.

Bounds: ``FIT_ROWS`` labelled rows are mined, chosen by a hash of doc_id, and as many documents are drawn for the
classifier, beside the labelled ones. A pattern is a subset of a fixed few voters, so their table has a bound whatever
the corpus. Labels are learned only from rows with ``crc32(doc_id) % 5 <> 0``. Scores see nothing but the text.

Defined cases: null and empty texts are scored (no votes but the clean ones); null labels and doc_ids don't train;
a doc_id with several labels is toxic if one of them is; without labels of both classes the fixed word lists and
default accuracies decide; an empty table gives no rows; other columns are ignored by ``score``, kept by ``reject``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, word_bytes

FOLDS = 5
FIT_ROWS = 20_000
LEXICON_VOTERS = 6
STEMS = (4, 5)
#: A mined term stands in so many toxic documents of the sample, and in this share of them; copies of one don't make a term.
MIN_DOCS, MIN_SHARE = 4, 0.03
#: A mined term must raise the log odds of toxic by so much.
MIN_ODDS = 3.0
#: Strength of a word of the fixed lists that wasn't mined.
LISTED = 2.0
PSEUDO_DOCS = 5.0
EM_ROUNDS = 25
KNOWN_WORDS = 1_000_000
#: Bytes of the words that a task remembers; then it forgets them.
KNOWN_BYTES = 64_000_000
#: Common insults of four languages.
INSULTS = {
    "en": "idiot moron stupid scum loser trash pathetic worthless disgusting clown dumb filth vermin imbecile",
    "de": "idiot trottel dumm abschaum versager müll erbärmlich wertlos widerlich depp blöd dreck ungeziefer schwachkopf",
    "fr": "idiot crétin stupide ordure raté déchet pathétique minable dégoûtant clown abruti crasse vermine imbécile",
    "es": "idiota cretino estúpido escoria perdedor basura patético inútil asqueroso payaso tonto mugre alimaña imbécil",
}

_WORD = re.compile(r"[^\W\d_]+")
_LISTS = {w: tuple(k for k, own in enumerate(INSULTS.values()) if w in own.split()) for own in INSULTS.values() for w in own.split()}


def stems(word: str) -> list[str]:
    """``foo*``: a stem leaves two letters or more."""
    return [word[:n] + "*" for n in STEMS if len(word) > n + 1]


def words_of(distinct: set[bytes]) -> set[str]:
    return set(_WORD.findall(b" ".join(distinct).decode("utf-8", "surrogatepass").lower()))


def terms(text: str | None) -> set[str]:
    """Words, stems, and with one more star the stems of several words."""
    words = words_of(set(word_bytes(text)))
    found = Counter(x for w in words for x in stems(w))
    return words | found.keys() | {x + "*" for x, n in found.items() if n > 1}


class Wanted:
    """Which of some terms stand in a text; the words met so far are kept with what they may name."""

    def __init__(self, names: frozenset[str]):
        self.names = names
        self.known: dict[str, tuple[tuple[str, ...], tuple[str, ...]] | None] = {}
        self.size = 0

    def _meet(self, word: str):
        parts = stems(word)
        alone = tuple(x for x in (word, *parts) if x in self.names)
        shared = tuple(x + "*" for x in parts if x + "*" in self.names)
        return (alone, shared) if alone or shared else None

    def __call__(self, text: str | None) -> set[str]:
        out, held = set(), Counter()
        if len(self.known) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        for w in words_of(set(word_bytes(text))):
            if w not in self.known:
                self.known[w] = self._meet(w)
                self.size += len(w)
            named = self.known[w]
            if named:
                out.update(named[0])
                held.update(named[1])
        return out | {x for x, n in held.items() if n > 1}


@dataclass
class Model:
    strength: dict[str, float] = field(default_factory=dict)  # log odds of a mined term
    voter: dict[str, int] = field(default_factory=dict)  # term -> lexicon voter
    weights: list[float] = field(default_factory=list)
    # words met so far, and what is known of the telling ones: strength, voters, lists, stems that tell if shared
    met: set[bytes] = field(default_factory=set, repr=False)
    telling: dict[bytes, tuple[float, tuple[int, ...], tuple[int, ...], tuple[str, ...]]] = field(default_factory=dict, repr=False)
    size: int = field(default=0, repr=False)

    def _meet(self, words: set[bytes]) -> None:
        if len(self.met) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self.met, self.telling, self.size = set(), {}, 0
        starts = {k.rstrip("*") for k in self.strength}  # of stems, and whole words
        for raw in words:
            for w in _WORD.findall(raw.decode("utf-8", "surrogatepass").lower()):
                lists = _LISTS.get(w, ())
                if not lists and w not in starts and all(w[:n] not in starts for n in STEMS):
                    continue
                parts = stems(w)
                mined = [k for k in (w, *parts) if k in self.strength]
                shared = tuple(x + "*" for x in parts if x + "*" in self.strength)
                if mined or lists or shared:
                    own = max([self.strength[k] for k in mined] + [LISTED] * bool(lists), default=0.0)
                    self.telling[raw] = own, tuple({self.voter[k] for k in mined}), lists, shared
        self.met |= words
        self.size += sum(map(len, words))

    def look(self, text: str | None) -> tuple[tuple[int, ...], list[float]]:
        """Votes and features of a text."""
        text = text or ""
        words = word_bytes(text)
        distinct, total = set(words), len(words)
        new = distinct - self.met
        if new:
            self._meet(new)
        found: dict[bytes, float] = {}
        lexicon, listed = [0] * LEXICON_VOTERS, [0] * len(INSULTS)
        several = 0
        maybe = distinct & self.telling.keys()
        if maybe:
            held = Counter(x for w in maybe for x in self.telling[w][3])
            for w in maybe:
                own, voters, lists, shared = self.telling[w]
                for x in shared:
                    if held[x] > 1:
                        own, voters, several = max(own, self.strength[x]), (*voters, self.voter[x]), several + 1
                for k in voters:
                    lexicon[k] = 1
                for k in lists:
                    listed[k] = 1
                if own:
                    found[w] = own
        counts = Counter(w for w in words if w in found) if found else {}
        hits, most = sum(counts.values()), max(counts.values(), default=0)
        best, strength = max(found.values(), default=0.0), sum(sorted(found.values()))
        shouts = text.count("!!")
        votes = (
            *lexicon,
            *listed,
            int(several > 0),
            int(len(found) >= 2),
            int(len(found) >= 3),
            int(hits * 200 > total and hits > 0),
            int(hits * 50 > total and hits > 0),
            int(most >= 2),
            int(shouts * 20 > total),
            -int(not found),
            -int(total >= 100 and len(found) < 2),
        )
        features = [
            1.0,
            *map(float, votes),
            math.log1p(hits),
            math.log1p(len(found)),
            best,
            min(strength, 20.0) / 5,
            math.log1p(several),
            100.0 * hits / (total + 20),
            math.log1p(total) / 5,
        ]
        return votes, features

    def score(self, features: list[float]) -> float:
        x = sum(a * b for a, b in zip(self.weights, features))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def remainder(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def chosen(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic of at most ``rows`` labelled training documents; the choice is by hash, so it repeats."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def _counted(texts: DataFrame, which) -> DataFrame:
    """term, n: in how many texts a term stands, of those that ``which(text)`` gives; the null term counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text in b.column("text").to_pylist():
                seen.update(which(text))
            terms = [None, *seen]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([b.num_rows, *seen.values()], pa.int64())], names=["term", "n"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mine(labelled: DataFrame) -> tuple[dict[str, float], int, int]:
    """Log odds of all terms that tell toxic documents, and the sizes of the classes.

    Toxic documents name the candidates; the others are searched for those alone.
    """
    toxic, clean = labelled.filter("toxic = 1"), labelled.filter("toxic <> 1")
    found = cut(_counted(toxic, terms))
    n_pos = found.filter("term IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(MIN_DOCS, MIN_SHARE * n_pos)
    # a toxic document's terms over MIN_SHARE at most
    pos = {r.term: r.n for r in found.filter(F.col("term").isNotNull() & (F.col("n") >= least)).collect()}
    shared = labelled.sparkSession.sparkContext.broadcast(Wanted(frozenset(pos)))
    neg = {r.term: r.n for r in _counted(clean, lambda text: shared.value(text)).collect()}
    n_neg = neg.pop(None, 0)
    odds = {}
    if n_pos and n_neg:
        base = n_pos / (n_pos + n_neg)
        for t, n in pos.items():
            # precision, drawn towards the base rate, against the base rate
            precision = (n + PSEUDO_DOCS * base) / (n + neg.get(t, 0) + PSEUDO_DOCS)
            odds[t] = round(math.log(precision / (1 - precision)) - math.log(base / (1 - base)), 9)
    return {t: s for t, s in odds.items() if s > MIN_ODDS}, n_pos, n_neg


def looks(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, votes (one sign each), features: one row per row, without the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [shared.value.look(t) for t in b.column("text").to_pylist()]
            votes = ["".join("-0+"[v + 1] for v in votes) for votes, _ in seen]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(votes, pa.string()), pa.array([x for _, x in seen], pa.list_(pa.float64()))],
                names=["doc_id", "votes", "features"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, votes string, features array<double>")


def _votes(signs: str) -> tuple[int, ...]:
    return tuple("-0+".index(c) - 1 for c in signs)


def label_model(table: list[tuple[tuple[int, ...], int]], seeds: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS):
    """Posterior of votes, estimated from the votes of all documents; the labelled seeds fix the classes."""
    votes = np.array([v for v, _ in table])
    n = np.array([c for _, c in table], dtype=float)
    j = votes.shape[1]

    def rates(v, w):  # (class, voter, vote) with one pseudo-count
        out = np.empty((2, j, 3))
        for y in (0, 1):
            for x in (-1, 0, 1):
                out[y, :, x + 1] = (w[:, y] @ (v == x)) + 1.0
        return out / out.sum(axis=2, keepdims=True)

    seed_votes = np.array([v for v, _ in seeds])
    seed_y = np.array([y for _, y in seeds])
    own = np.stack([seed_y == 0, seed_y == 1], axis=1).astype(float)
    rate = rates(seed_votes, own)
    prior = math.log((seed_y.sum() + 1) / ((seed_y == 0).sum() + 1))
    temper = np.ones(j)

    def odds(v):
        logs = np.log(rate[1]) - np.log(rate[0])
        return prior + (logs[np.arange(j), v + 1] * temper).sum(axis=1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(odds(votes), -60, 60)))
        w = np.stack([n * (1 - p), n * p], axis=1)
        # correlation of voters given the class: what repeats another voter counts less
        rho = np.zeros((j, j))
        for y in (0, 1):
            share = w[:, y] / max(w[:, y].sum(), 1e-9)
            centred = votes - share @ votes
            cov = centred.T @ (centred * share[:, None])
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            rho = np.maximum(rho, np.abs(cov / sd[:, None] / sd[None, :]))
        np.fill_diagonal(rho, 0)
        temper = 1 / (1 + (rho * (rho > 0.3)).sum(axis=1))
        rate = rates(np.vstack([votes, seed_votes]), np.vstack([w, own]))
        prior = math.log((w[:, 1].sum() + 1) / (w[:, 0].sum() + 1))

    return lambda v: 1 / (1 + np.exp(-np.clip(odds(np.asarray(v)), -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights for soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def targets(seen: DataFrame, sample: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and posteriors of the documents that the classifier is trained on; no label is among them."""
    table = sorted((_votes(r.votes), r.n) for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in table)
    labelled = seen.join(F.broadcast(sample), "doc_id")
    drawn = seen.filter(F.pmod(F.xxhash64("doc_id", "votes"), F.lit(max(1, -(-total // rows)))) == 0).withColumn("toxic", F.lit(None).cast("int"))
    # by hash again, so that ties of the draw can't lift the bound
    drawn = drawn.orderBy(F.xxhash64("doc_id", "votes", "features")).limit(rows)
    found = drawn.unionByName(labelled.select(drawn.columns)).collect()  # twice `rows` short rows at most
    found.sort(key=lambda r: (r.votes, r.features, -1 if r.toxic is None else r.toxic))
    seeds = [(_votes(r.votes), int(r.toxic == 1)) for r in found if r.toxic is not None]
    posterior = label_model(table, seeds)
    return np.array([r.features for r in found]), posterior([_votes(r.votes) for r in found])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Model, DataFrame]:
    """The model, and the looks of all documents."""
    sample = chosen(labels, rows)
    odds, n_pos, n_neg = mine(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    ranked = sorted(odds, key=lambda t: (-odds[t], t))
    model = Model(strength=odds, voter={t: k * LEXICON_VOTERS // len(ranked) for k, t in enumerate(ranked)})
    seen = cut(looks(docs, model))
    if n_pos and n_neg:
        weights = logistic(*targets(seen, sample, rows)).tolist()
    else:
        weights = [0.0] * len(model.look("")[1])
        weights[0] = -3.0
        weights[1 + LEXICON_VOTERS : 1 + LEXICON_VOTERS + len(INSULTS)] = [5.0] * len(INSULTS)
    return Model(odds, model.voter, weights), seen


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    model, seen = fit(docs, labels)
    x = F.aggregate(F.zip_with("features", F.array(*map(F.lit, model.weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
    df = seen.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), p.alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with all their columns: the texts are looked at once more where they stand."""
    model, _ = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def by(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(shared.value.look(t)[1]) for t in texts], dtype="float64")

    # the row travels as one struct, so its names can't clash with the ones used here
    return docs.select(F.struct("*").alias("row"), by(F.col("text").cast("string")).alias("score")).filter("score < 0.5").select("row.*")
