"""Operator 4: quality by weak supervision, in DataFrame functions only.

Rules look at counts of the text and vote good (1), bad (-1) or abstain (0). Defect rules vote bad or abstain, two rules
vote good on what reads like prose; an abstention is no evidence. How often each rule fires on good and on bad
documents comes from expectation-maximisation over the table of vote patterns, which is counted over all documents
and has at most 3**rules rows. The posterior probability of "good", not a demand that all rules pass, decides.

Repeated windows are found inside the row: word hashes are doubled into hashes of 2, 4 and 8 words, and only the
texts in which some 8-word hash occurs twice sort their windows; equal hashes count if their words are equal too. No row
leaves its task.

Defined cases: null and empty texts have no words, all counts are 0, and the base rule fails them; repeated rows
get the same verdict; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
RULES = ("length", "word_length", "symbols", "lines", "repeats", "letters", "capitals", "prose", "sentences")
EM_ROUNDS = 50
PRIOR_GOOD = 0.8
#: No vote weighs more than this many nats, so no rule decides whatever the others say.
MOST = 6.0
#: So many documents, spread like the corpus, are held to be as ``START`` says in every round; their weight fades as documents grow.
PSEUDO_DOCS = 300.0
#: Where the estimation starts, by (a bad vote, good votes: 0 none, 1 some, 2 as many as any document has). A bad vote is
#: taken to be right unless all good rules speak against it; then the prior stands.
START = {(False, 0): PRIOR_GOOD, (False, 1): 0.95, (False, 2): 0.95, (True, 0): 0.1, (True, 1): 0.1, (True, 2): PRIOR_GOOD}


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts on which contract and rules rest: one row per input row, without the text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    letters = F.regexp_replace("t", r"[^\p{L}]+", "")
    df = df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"[.?!…。]")).cast("long").alias("n_stops"),
        "w",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # zip_with pads the shorter side, so the last hashes of each doubling are void and cut off at the end
    for step in (1, 2, 4):
        df = df.withColumn("h", F.zip_with("h", F.slice("h", F.lit(step + 1), F.size("h") + 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(
        "h", F.when(F.col("n_words") >= WINDOW, F.slice("h", F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")))
    )
    df = df.withColumn("repeats", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    window = lambda i: F.array_join(F.slice("w", i + 1, WINDOW), " ")
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), window(i).alias("words"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.col("repeats"), placed)).drop("h", "w")
    same = lambda a, b: (a.x == b.x) & (a.words == b.words)
    twice = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.when(same(a, b), F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("at", F.when(F.col("repeats"), F.array_sort(F.array_distinct(F.flatten(twice))))).drop("s", "repeats")
    covered = F.zip_with(
        "at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    )
    return df.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    ).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """One column of 1, 0 or -1 per rule."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    bad = lambda when: F.when(when, -1).otherwise(0)
    good = lambda when: F.when(when, 1).otherwise(0)
    n, word, symbols = F.col("n_words"), ratio("word_chars", "n_words"), ratio("n_symbols", "n_words")
    dup, repeats = ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words")
    letters, capitals = ratio("n_letters", "word_chars"), ratio("n_capitals", "n_letters")
    prose = (n >= 30) & word.between(3, 10) & (symbols < 0.05) & (repeats < 0.15) & (letters >= 0.75) & (capitals < 0.25)
    return {
        "length": bad(n < 20),
        "word_length": bad((word < 2.5) | (word > 14)),
        "symbols": bad(symbols > 0.2),
        "lines": bad((dup > 0.3) & (F.col("n_dup_lines") >= 3)),
        "repeats": bad(repeats > 0.25),
        "letters": bad(letters < 0.75),
        "capitals": bad((capitals > 0.5) & (n >= 10)),
        "prose": good(prose),
        "sentences": good((ratio("n_stops", "n_words").between(0.01, 0.4)) & (n >= 20)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log prior odds of "good", and per rule the log-likelihood ratio of each vote, by expectation-maximisation.

    ``patterns``: votes and how many documents cast them. Starts from the guess that a bad vote is right. A rule is
    taken to be no worse than chance: its vote never counts for the other side. That fixes what the classes mean.
    """
    start = math.log(PRIOR_GOOD / (1 - PRIOR_GOOD))
    if not patterns:
        return start, [{-1: -3.0, 0: 0.0, 1: 1.0} for _ in RULES]
    most = max(v.count(1) for v, _ in patterns)
    guess = {v: START[min(v) < 0, 2 if v.count(1) == most > 0 else int(1 in v)] for v, _ in patterns}
    pseudo = PSEUDO_DOCS / sum(n for _, n in patterns)
    good, prior, ratios = guess, start, []
    for _ in range(rounds):
        # documents of each pattern that are good and bad
        share = {v: (n * (good[v] + pseudo * guess[v]), n * (1 - good[v] + pseudo * (1 - guess[v]))) for v, n in patterns}
        mass = [sum(s[k] for s in share.values()) for k in (0, 1)]
        ratios = []
        for j in range(len(patterns[0][0])):
            ratio = {0: 0.0}
            for x in (-1, 1):
                # one firing in either class before any is seen
                fired = [1.0 + sum(s[k] for v, s in share.items() if v[j] == x) for k in (0, 1)]
                found = math.log(fired[0] / (mass[0] + 2)) - math.log(fired[1] / (mass[1] + 2))
                ratio[x] = min(MOST, max(0.0, found)) if x > 0 else max(-MOST, min(0.0, found))
            ratios.append(ratio)
        prior = max(-MOST, min(MOST, math.log((mass[0] + 1) / (mass[1] + 1))))
        good = {v: 1 / (1 + math.exp(-(prior + sum(r[x] for r, x in zip(ratios, v))))) for v, _ in patterns}
    return prior, ratios


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior, kept: one row per input row."""
    df = cut(counts(docs))
    cast = votes()
    table = df.groupBy(*(v.alias(k) for k, v in cast.items())).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, ratios = fit(sorted((tuple(r[k] for k in RULES), r.n) for r in table))  # at most 3**rules rows
    odds = F.lit(prior)
    for name, ratio in zip(RULES, ratios):
        odds = odds + F.when(cast[name] > 0, ratio[1]).when(cast[name] < 0, ratio[-1]).otherwise(ratio[0])
    posterior = 1 / (1 + F.exp(-odds))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), posterior.alias("posterior"), (~base_failed() & (posterior >= 0.5)).alias("kept"),
    )
