"""Operator 2: secrets by fixed patterns and by a battery of randomness tests, in DataFrame functions only.

Base patterns give the kinds ``assign``, ``access`` and ``hex``. The battery looks at long tokens, infers the
encoding from the characters (every token has one), and measures how far a token is from uniform, independent symbols: a
chi-squared test of the symbol counts, a runs test about the middle of the alphabet, a lag-one serial correlation test
and, where the alphabet has all letters, a chi-squared test of the common letters against the rest (which tells words),
joined by Fisher's rule. The distance per symbol is the statistic: low for keys, high for words.

The hypothesis to be rejected is that a token is made of words, so the error under control is the false alarm. What words
look like is learned from all documents: each one gives a token of its own words in a row, at a place and in a length and
spelling (one case or two, with digits or without) drawn by hash; the median of their statistic's logarithm and the
deviation below it, by spelling and length class, give the p-value. Tokens whose p-value the Benjamini-Hochberg procedure lets through, run apart for each
spelling and length class (longer tokens have more power, and their p-values would otherwise drive the cut for short
ones), are the discoveries, of kind ``random``. Numbers have no words to be like; there the battery alone decides.

``-``, ``_``, ``+`` and ``/`` are symbols in tokens with a digit and both cases, else separators; a token with separators
is tested whole without them, and by each long part between them, which counts only if the whole doesn't.

The first pass keeps what was found of each document, without the text, and gives a small table: counts of tokens and of
words by spelling, length class and bin of the statistic (at most 2 x ``SPELLINGS`` x 4 x ``BINS`` rows). Work is linear in the
matches of a text, but for short chunks.

Defined cases: null and empty texts have no spans; repeated rows are judged row by row alike; a table without
candidates has no cut; a class with few documents leans on ``LIKE_WORDS``; other columns of the input are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole token of 20 or more symbols, and a part between separators.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
PART = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
SYMBOLS = 20
KINDS = ("assign", "access", "hex", "random")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALL = _UPPER + _LOWER + _DIGITS + "+/"
#: Encodings without separators, in the order in which they are tried: pattern, alphabet. All else is ``_ALL``.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z]+$", _UPPER),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
)
#: Fixed value: the most common letters of running text.
COMMON = "etaoinsr"
#: Spellings: numbers, letters of one case or two, the same with digits.
SPELLINGS = ("digits", "letters", "camel", "coded", "mixed")
#: Median and deviation below it of the statistic's logarithm for words, by spelling and length class, and for how many tokens that stands.
LIKE_WORDS = {
    "letters": ((0.10, 0.25), (0.42, 0.33), (0.91, 0.35), (0.75, 0.08)), "camel": ((0.16, 0.25), (0.50, 0.33), (0.95, 0.30), (0.75, 0.08)),
    "coded": ((0.10, 0.25), (0.54, 0.35), (0.98, 0.25), (0.75, 0.08)), "mixed": ((0.08, 0.26), (0.56, 0.36), (0.98, 0.25), (0.75, 0.08)),
}
LIKE_DOCS = 200
FALSE_DISCOVERY_RATE = 0.05
#: A number whose battery gives less than this is no random one.
NUMBER_LEVEL = 0.01
#: Bins of the statistic's logarithm from ``LEAST`` on, ``SCALE`` to one.
LEAST, SCALE, BINS = -5.0, 100, 800
LENGTH_CLASSES = (32, 64, 128)
LONGEST = 256
CHUNK = 128
#: Characters of a block of a text that is masked.
BLOCK = 4096
MASK = "[SECRET]"

_MATCH = "array<struct<start:bigint,end:bigint,token:string>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _chunks(array: Column) -> Column:
    """An array in short slices, so that what grows inside a fold stays short."""
    return F.when(
        F.size(array) > 0,
        F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda c: F.slice(array, c * CHUNK + 1, CHUNK)),
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a column that is named within a lambda would be again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(array: Column, start: Column, kind: str, step) -> Column:
    """``step(at, x)`` gives (value, next at) for each element in order; the array of values."""
    empty = F.array().cast(kind)

    def inner(acc, x):
        value, after = step(acc.at, x)
        return F.struct(after.alias("at"), F.concat(acc.out, F.array(value)).alias("out"))

    def outer(acc, chunk):
        done = F.aggregate(chunk, F.struct(acc.at.alias("at"), empty.alias("out")), inner)
        return F.struct(done.at.alias("at"), F.concat(acc.out, F.array(done.out)).alias("out"))

    first = F.struct(start.cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.coalesce(F.aggregate(_chunks(array), first, outer, lambda acc: F.flatten(acc.out)), empty)


def _placed(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds array ``name`` of all matches with their places: gaps between matches come from a split."""
    found, gaps, pairs = (F.col(f"_{x}_{name}") for x in ("found", "gaps", "pairs"))

    def step(at, x):
        start, end = at + x.g, at + x.g + F.length(x.m)
        return F.struct(start.alias("start"), end.alias("end"), x.m.alias("token")), end

    df = df.withColumn(f"_found_{name}", _matches(F.col("_text"), pattern))
    df = df.withColumn(f"_gaps_{name}", F.when(F.size(found) > 0, F.split("_text", pattern, -1)))
    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    df = df.withColumn(f"_pairs_{name}", F.when(F.size(found) > 0, zipped))
    return df.withColumn(name, _folded(pairs, F.lit(0), _MATCH, step)).drop(*(f"_{x}_{name}" for x in ("found", "gaps", "pairs")))


def _tail(z: Column) -> Column:
    """P(Z > z) by the logistic approximation of the normal distribution (error below 0.0002)."""
    return F.lit(1.0) / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _statistics(tokens: Column) -> Column:
    """array<struct<start, end, whole, part, spelling, n, t, p>> of tokens (start, end, token, whole); short ones go.

    Each transform binds what the next uses. ``whole`` is the start of the token that a part lies in, its own for a whole.
    """

    def encoded(c):
        body = F.rtrim(c.token, F.lit("="))
        bare = F.translate(body, "-_+/", "")
        digit, low, high = (bare.rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
        both = digit & low & high
        letters = F.lit(_ALL)
        for pattern, alphabet in reversed(ENCODINGS):
            letters = F.when(bare.rlike(pattern), F.lit(alphabet)).otherwise(letters)
        spelling = F.when(both, 4).when(low & high, 2).when(digit & (low | high), 3).when(digit, 0).otherwise(1)
        symbols = F.when(both, F.translate(body, "-_", "+/")).otherwise(bare)
        return F.struct(
            c.start.alias("start"), c.end.alias("end"), c.whole.alias("whole"), c.part.alias("part"), spelling.alias("spelling"), symbols.alias("symbols"), letters.alias("letters")
        )

    def coded(c):
        codes = F.transform(F.split(c.symbols, ""), lambda s: F.instr(c.letters, s) - 1)
        low = F.lower(c.symbols)
        count = lambda some: (F.length(low) - F.length(F.translate(low, some, ""))).cast("double")
        return F.struct(
            c.start.alias("start"),
            c.end.alias("end"),
            c.whole.alias("whole"),
            c.part.alias("part"),
            c.spelling.alias("spelling"),
            F.length(c.letters).cast("double").alias("k"),
            count(_LOWER).alias("n_letters"),
            count(COMMON).alias("n_common"),
            F.aggregate(
                F.array_distinct(F.split(c.symbols, "")), F.lit(0.0),
                lambda a, x: a + F.pow((F.length(c.symbols) - F.length(F.replace(c.symbols, x, F.lit("")))).cast("double"), F.lit(2.0)),
            ).alias("squares"),
            codes.alias("codes"),
        )

    def summed(c):
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        mean = total(F.transform(c.codes, lambda x: x.cast("double"))) / F.size(c.codes)
        return F.struct(
            c.start.alias("start"),
            c.end.alias("end"),
            c.whole.alias("whole"),
            c.part.alias("part"),
            c.spelling.alias("spelling"),
            c.n_letters.alias("n_letters"),
            c.n_common.alias("n_common"),
            c.k.alias("k"),
            F.size(c.codes).cast("double").alias("n"),
            c.codes.alias("codes"),
            mean.alias("mean"),
            c.squares.alias("squares"),
            total(F.transform(c.codes, lambda x: F.when(x * 2 >= c.k, 1.0).otherwise(0.0))).alias("high"),
            total(
                F.zip_with(
                    c.codes,
                    F.slice(c.codes, F.lit(2), F.size(c.codes)),
                    lambda a, b: F.when(b.isNotNull() & ((a * 2 >= c.k) != (b * 2 >= c.k)), 1.0).otherwise(0.0),
                )
            ).alias("turns"),
        )

    def correlated(c):
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        share = len(COMMON) / len(_LOWER)
        return F.struct(
            c.start.alias("start"),
            c.end.alias("end"),
            c.whole.alias("whole"),
            c.part.alias("part"),
            c.spelling.alias("spelling"),
            ((c.k >= 26) & (c.n_letters > 0)).alias("words"),
            ((c.n_common - share * c.n_letters) / F.sqrt(share * (1 - share) * F.greatest(c.n_letters, F.lit(1.0)))).alias("z_words"),
            c.n.alias("n"),
            ((c.k / c.n * c.squares - c.n - (c.k - 1)) / F.sqrt(2 * (c.k - 1) * (1 - 1 / c.n))).alias("z_uniform"),
            (2 * c.high * (c.n - c.high) / c.n + 1).alias("mu"),
            (c.turns + 1).alias("runs"),
            total(F.transform(c.codes, lambda x: (x - c.mean) * (x - c.mean))).alias("variation"),
            total(
                F.zip_with(
                    c.codes,
                    F.slice(c.codes, F.lit(2), F.size(c.codes)),
                    lambda a, b: F.coalesce((a - c.mean) * (b - c.mean), F.lit(0.0)),
                )
            ).alias("lagged"),
        )

    def tested(c):
        spread = (c.mu - 1) * (c.mu - 2) / (c.n - 1)
        z_runs = F.when(spread > 0, (c.runs - c.mu) / F.sqrt(spread)).otherwise(40.0)
        z_serial = F.when(c.variation > 0, (c.lagged / c.variation + 1 / c.n) * F.sqrt(c.n)).otherwise(40.0)
        logs = [F.log(F.greatest(p, F.lit(1e-300))) for p in (_tail(c.z_uniform), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))]
        words = F.when(c.words, F.log(F.greatest(_tail(c.z_words), F.lit(1e-300)))).otherwise(0.0)
        x = F.greatest(F.lit(0.0), -(logs[0] + logs[1] + logs[2] + words))
        return F.struct(c.start.alias("start"), c.end.alias("end"), c.whole.alias("whole"), c.part.alias("part"), c.spelling.alias("spelling"), c.words.alias("words"), c.n.alias("n"), x.alias("x"))

    def joined(c):
        # Fisher's rule for three or four tests: chi-squared with six or eight degrees of freedom has a closed tail
        p = F.exp(-c.x) * (1 + c.x + c.x * c.x / 2 + F.when(c.words, c.x * c.x * c.x / 6).otherwise(0.0))
        return F.struct(
            c.start.alias("start"), c.end.alias("end"), c.whole.alias("whole"), c.part.alias("part"), c.spelling.alias("spelling"), c.n.alias("n"),
            F.sqrt(c.x / c.n).alias("t"), F.least(p, F.lit(1.0)).alias("p"),
        )

    out = F.filter(F.transform(tokens, encoded), lambda c: F.length(c.symbols) >= SYMBOLS)
    for step in (coded, summed, correlated, tested, joined):
        out = F.transform(out, step)
    return out


def _token(start: Column, end: Column, token: Column, whole: Column, part: bool = False) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), token.alias("token"), whole.alias("whole"), F.lit(part).alias("part"))


def _parts(c: Column) -> Column:
    """The long parts of a token between separators, if it has some."""
    pieces = F.split(c.token, "(?<=[-_+/=])(?=[^-_+/=])|(?<=[^-_+/=])(?=[-_+/=])")

    def step(at, x):
        return _token(at, at + F.length(x), x, c.start, True), at + F.length(x)

    kind = "array<struct<start:bigint,end:bigint,token:string,whole:bigint,part:boolean>>"
    return F.filter(_folded(F.when(c.token.rlike("[-_+/]"), pieces), c.start, kind, step), lambda x: x.token.rlike(PART))


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, limit in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n < limit, i).otherwise(out)
    return out


def _cell(c: Column) -> Column:
    return c["spelling"] * (len(LENGTH_CLASSES) + 1) + _length_class(c["n"])


def _bin(t: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((F.log(F.greatest(t, F.lit(1e-3))) - LEAST) * SCALE), F.lit(BINS - 1))).cast("int")


def _like_words(text: Column) -> Column:
    """A token of the document's own words, or none where they are too few. Place, length and spelling come from a hash.

    Each transform of the one element binds what the next uses.
    """
    lows = (SYMBOLS, *LENGTH_CLASSES)
    highs = (*LENGTH_CLASSES, LONGEST)
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    part = lambda h, shift, m: F.pmod(F.shiftright(h, shift), m).cast("int")

    def sized(x):
        k = part(x.h, 0, F.lit(len(lows)))
        n = pick(lows, k) + part(x.h, 8, pick([b - a for a, b in zip(lows, highs)], k))
        return F.struct(x.h.alias("h"), n.alias("n"), (part(x.h, 4, F.lit(4)) + 1).alias("spelling"))

    def seen(x):
        at = 1 + part(x.h, 16, F.greatest(F.lit(1), F.length(text) - 3 * x.n))
        window = F.regexp_replace(F.regexp_replace(text.substr(at, 3 * x.n), CANDIDATE, " "), "[^A-Za-z]+", " ")
        digits = F.when(x.spelling > 2, F.substring(F.lpad(part(x.h, 24, F.lit(10_000)).cast("string"), 4, "0"), 1, 1 + part(x.h, 6, F.lit(4)))).otherwise("")
        return F.struct(x.n.alias("n"), digits.alias("digits"), F.when(x.spelling % 2 == 0, F.initcap(window)).otherwise(F.lower(window)).alias("words"))

    def joined(x):
        words = F.replace(x.words, F.lit(" "), F.lit(""))
        return F.struct(x.n.alias("n"), F.concat(words.substr(F.lit(1), x.n - F.length(x.digits)), x.digits).alias("token"))

    nowhere = F.lit(-1).cast("bigint")
    made = F.array(F.struct(F.xxhash64(text).alias("h")))
    for step in (sized, seen, joined):
        made = F.transform(made, step)
    return F.transform(F.filter(made, lambda x: F.length(x.token) == x.n), lambda x: _token(nowhere, nowhere, x.token, nowhere))


def _tested(df: DataFrame, like_words: bool) -> DataFrame:
    """Adds ``_tested`` to rows with ``_text``; a token made of the document's words has no place."""
    df = _placed(df, "_candidates", CANDIDATE)
    tokens = F.flatten(F.transform("_candidates", lambda c: F.concat(F.array(_token(c.start, c.end, c.token, c.start)), _parts(c))))
    if like_words:
        tokens = F.concat(tokens, _like_words(F.col("_text")))
    return df.withColumn("_tested", _statistics(tokens)).drop("_candidates")


def _based(df: DataFrame) -> DataFrame:
    """Adds ``_base``, array of (start, kind, end) in order, and the counts of its kinds."""
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX)):
        df = _placed(df, f"_{kind}", pattern)
    # a shorter value makes the match fail, and the search goes on behind it
    value = lambda m: F.regexp_extract(m.token, "^" + ASSIGN, 1)
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(value(m)) >= 6))
    spans = lambda kind: F.transform(
        f"_{kind}", lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m.end.alias("end"))
    )
    df = df.withColumn("_base", F.array_sort(F.concat(*map(spans, KINDS[:3]))))
    return df.withColumns({f"_n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS[:3]}).drop(*(f"_{kind}" for kind in KINDS[:3]))


def words_model(spelling: str, length_class: int, seen: dict[int, int]) -> tuple[float, float]:
    """Median and lower deviation of words, from their counts by bin and what is known beforehand."""
    median, deviation = LIKE_WORDS[spelling][length_class]
    n = sum(seen.values())
    if not n:
        return median, deviation
    middle = lambda b: LEAST + (b + 0.5) / SCALE
    below, own = 0, median
    for b in sorted(seen):
        below += seen[b]
        if 2 * below >= n:
            own = middle(b)
            break
    low = [(own - middle(b), k) for b, k in seen.items() if middle(b) < own]
    held = sum(k for _, k in low)
    spread = sum(k * x * x for x, k in low) / held if held else deviation**2
    weight = n / (n + LIKE_DOCS)
    return weight * own + (1 - weight) * median, math.sqrt(weight * spread + (1 - weight) * deviation**2)


def p_value(x: float, model: tuple[float, float]) -> float:
    """How often words would give so low a logarithm of the statistic."""
    return 0.5 * math.erfc((model[0] - x) / (model[1] * math.sqrt(2)))


def first_words(counts: dict[int, int], model: tuple[float, float], rate: float) -> int:
    """The first bin that counts as words: Benjamini-Hochberg over the tokens of each bin, by the p-value of its end."""
    m, below, first = sum(counts.values()), 0, 0
    for b in sorted(counts):
        below += counts[b]
        if p_value(LEAST + (b + 1) / SCALE, model) <= rate * below / m:
            first = b + 1
    return first


def cuts_of(tested: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> dict[int, int]:
    """Per spelling and length class the first bin of the statistic from which on a token counts as words."""
    c = F.col("c")
    counts = tested.select(F.explode("_tested").alias("c")).groupBy(_cell(c).alias("cell"), (c["start"] < 0).alias("words"), _bin(c["t"]).alias("bin"))
    seen: dict[tuple[int, bool], dict[int, int]] = {}
    for r in counts.agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * BINS rows per cell
        seen.setdefault((r.cell, r.words), {})[r.bin] = r.n
    out = {}
    for cell, words in sorted(seen):
        spelling, length_class = divmod(cell, len(LENGTH_CLASSES) + 1)
        if spelling and not words:
            model = words_model(SPELLINGS[spelling], length_class, seen.get((cell, True), {}))
            out[cell] = first_words(seen[cell, False], model, rate)
    return out


def _with_spans(df: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """Adds ``_spans``, array of (start, kind, end) in order, to rows with ``_tested`` and ``_base``."""
    limit = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(cuts.items()) for x in kv)), _cell(c)), F.lit(0)) if cuts else F.lit(0)
    # base spans in chunks with their bounds, so that few of them are looked at for a token
    chunks = F.transform(
        _chunks(F.col("_base")),
        lambda b: F.struct(b.alias("b"), F.array_min(F.transform(b, lambda x: x.start)).alias("start"), F.array_max(F.transform(b, lambda x: x.end)).alias("end")),
    )
    over = lambda b, c: (b.start < c.end) & (c.start < b.end)
    covered = lambda chunks, c: F.coalesce(F.exists(chunks, lambda k: over(k, c) & F.exists(k.b, lambda b: over(b, c))), F.lit(False))
    random = lambda c: F.when(c["spelling"] == 0, c["p"] >= NUMBER_LEVEL).otherwise(_bin(c["t"]) < limit(c))
    free = lambda x: F.filter(x.tested, lambda c: (c.start >= 0) & random(c) & ~covered(x.chunks, c))
    df = df.withColumn("_random", _bound(F.struct(F.col("_tested").alias("tested"), chunks.alias("chunks")), free))
    # parts follow their whole and count only if it doesn't
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    span = lambda c: F.array(F.struct(c.start.alias("start"), F.lit(3).alias("kind"), c.end.alias("end")))
    kept = _folded(
        F.col("_random"), F.lit(-1), f"array<{kind}>",
        lambda at, c: (F.when(c.part & (c.whole == at), F.array().cast(kind)).otherwise(span(c)), F.when(c.part, at).otherwise(c.whole)),
    )
    return df.withColumn("_spans", F.array_sort(F.concat("_base", F.flatten(kept)))).drop("_random")


def _told(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: one row per input row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    # one look at the texts; what is kept of them is small
    found = cut(_based(_tested(rows, like_words=True)).drop("_text"))
    df = _with_spans(found, cuts_of(found))
    return df.select(
        "doc_id",
        *(F.col(f"_n_{kind}").alias(f"n_{kind}") for kind in KINDS[:3]),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_random"),
        F.sha2(_told("_base"), 256).alias("base_sha256"),
        _told("_spans").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows, other columns stay."""
    columns = docs.columns
    # the row travels as one struct, so its names can't clash with the ones used here
    rows = docs.select(F.struct("*").alias("row"), "text", F.coalesce("text", F.lit("")).alias("_text"))
    cuts = cuts_of(_tested(rows.select("_text"), like_words=True))
    df = _with_spans(_based(_tested(rows, like_words=False)), cuts)
    # the text in blocks, so that a piece of it is found without walking through all that stands before
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("_text") / BLOCK).cast("int")), lambda k: F.col("_text").substr(k * BLOCK + 1, F.lit(BLOCK))
    )

    def between(blocks, at, end):
        first = F.floor(at / BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return held.substr((at - first * BLOCK + 1).cast("int"), (end - at).cast("int"))

    def piece(blocks, at, s):
        """The text before a span and the mark; spans that overlap share one mark."""
        before = F.when(s.start > at, between(blocks, at, s.start)).otherwise("")
        return F.concat(before, F.when(s.start >= at, F.lit(MASK)).otherwise("")), F.greatest(at, s.end)

    last = F.array_max(F.transform("_spans", lambda s: s.end))
    pieces = _bound(
        F.struct(F.col("_spans").alias("spans"), blocks.alias("blocks")),
        lambda x: _folded(x.spans, F.lit(0), "array<string>", lambda at, s: piece(x.blocks, at, s)),
    )
    masked = F.concat(F.array_join(pieces, ""), F.col("_text").substr((last + 1).cast("int"), F.length("_text")))
    found = F.size("_spans") > 0
    df = df.select("row", F.when(found, masked).otherwise(F.col("text")).alias("text"), found.alias("found"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return df.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in columns))
