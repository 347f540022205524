"""Operator 3: licence notices by Aho-Corasick, and licence expressions by a shunting-yard parser.

One automaton over the word sequence of a text (lower-cased A-Z, words joined by single spaces) finds the three base
phrases, further notice phrases and the identifier tag. Where the automaton has found a tag and a colon follows, an
expression with ``and``, ``or``, ``with`` and parentheses is read from the raw text, to the end of the line and at any
length. Operands follow the grammar of identifiers. A name of ``FAMILIES`` (with a version and ``only``, ``or-later`` or
``+``), one of ``NAMES`` or a ``LicenseRef-`` is one wherever it stands. Any other counts if it looks like an identifier (a
digit, or several capitals beside an operator) and an operator, a parenthesis or the end follows it: prose goes on with a word.
The longest start that is an expression counts, so an unknown name never voids what stands before it or around it.
``n_choices`` counts the ways to take one side of every ``or`` (a sum for ``or``, a product for ``and``; a repeated licence
counts each time). A licence without a label is labelled by its identifier.

Score: 0 without evidence, else 1 - 0.5 ** (places + 3 * readable tags): more evidence, closer to 1.

Defined cases: null and empty texts have no words, places or labels and score 0; an expression that can't be read
gives no label; more choices than a long holds count as ``MOST``; overlapping places count each; repeated rows are told
alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_bytes

#: Base phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices.
NOTICES = {
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons": "cc",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
    "isc license": "isc",
    "unlicense": "public-domain",
}
TAG = "spdx license identifier"
_EXPRESSION = re.compile(r"[ \t]*:[ \t]*([A-Za-z0-9.+\-() \t]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
#: Words of the raw text, as the automaton counts them.
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Names of licences in identifiers, and the labels of those that have a notice.
FAMILIES = {
    "mit": "mit", "mit-0": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "bsd": "bsd", "0bsd": "bsd",
    "mpl": "mpl", "cc0": "cc", "cc-by": "cc", "cc-by-sa": "cc", "cc-by-nc": "cc", "cc-by-nd": "cc", "cc-by-nc-sa": "cc", "cc-by-nc-nd": "cc",
    "isc": "isc", "unlicense": "public-domain", "zlib": "zlib", "epl": "epl", "eupl": "eupl", "cddl": "cddl", "cpl": "cpl", "bsl": "bsl",
    "artistic": "artistic", "wtfpl": "wtfpl", "python": "python", "psf": "psf", "openssl": "openssl", "ofl": "ofl", "postgresql": "postgresql",
    "ncsa": "ncsa", "x11": "x11", "w3c": "w3c", "unicode": "unicode", "afl": "afl", "osl": "osl", "vim": "vim", "ruby": "ruby", "ms-pl": "ms-pl",
}
_IDENTIFIER = re.compile(r"(?:licenseref|documentref)-[a-z0-9.\-]+|(%s)(?:-v?[0-9][a-z0-9.]*(?:-[a-z0-9.]+)*?)?(?:-only|-or-later|\+)?" % "|".join(sorted(map(re.escape, FAMILIES), key=len, reverse=True)))
#: Identifiers of one word that belong to no family above.
NAMES = frozenset(
    "abstyles aladdin aml barr beerware blessing borceux caldera crossword cube curl diffmark doc dsdp dvipdfm egenix entessa eurosym fair "
    "ftl glide glulxe haskellreport hpnd icu ijg imagemagick intel jasper json latex2e leptonica libpng libtiff lppl makeindex miros mpich2 "
    "multics naumen newsletr nokia noweb ntp php plexus psfrag psutils qhull qpl rdisc sendmail sissl sleepycat smlnj snia tcl tosl upl "
    "vostrom watcom xerox xinetd xnet xpp xskat zed zend zpl".split()
)
_LIKE = re.compile(r"(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[a-z0-9.]+(?:-[a-z0-9.]+)*\+?")
_CAPITALS = re.compile(r"[A-Za-z.\-]*[A-Z][A-Za-z.\-]*[A-Z][A-Za-z.\-]*\+?")
_EXCEPTION = re.compile(r"[a-z0-9.\-]*exception[a-z0-9.\-]*|llgpl|swi-exception|[a-z]+-linking")
_RANK = {"or": 1, "and": 2, "with": 3}

_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_tags long, n_choices long, score double"
#: The largest long: ``n_choices`` stays there instead of running over.
MOST = 2**63 - 1


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the tokens aren't an expression."""
    out, waiting, operand_next = [], [], True
    for t in tokens:
        low = t.lower()
        if low in _RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            waiting.append(t)
        elif t == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(low)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def choices(postfix: list[str]) -> frozenset[frozenset[str]]:
    """Sets of licences of which one must hold in full. They can double at each step, so the scan only counts them."""
    stack: list[frozenset[frozenset[str]]] = []
    for t in postfix:
        if t not in _RANK:
            stack.append(frozenset([frozenset([t])]))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "or":
            stack.append(left | right)
        elif t == "with":  # an exception goes with the licence before it
            stack.append(left)
        else:
            stack.append(frozenset(a | b for a in left for b in right))
    return stack[0]


def operands(postfix: list[str]) -> tuple[set[str], int]:
    """The licences of an expression, and in how many ways one side of every ``or`` can be taken."""
    names: list[str] = []
    stack: list[tuple[int, int]] = []  # ways, and where the operand's names start
    for t in postfix:
        if t not in _RANK:
            stack.append((1, len(names)))
            names.append(t)
            continue
        (right, start), (left, first) = stack.pop(), stack.pop()
        if t == "with":  # an exception goes with the licence before it
            del names[start:]
            stack.append((left, first))
        else:
            stack.append((min(left + right if t == "or" else left * right, MOST), first))
    return set(names), stack[0][0]


def readable_start(raw: str) -> list[str] | None:
    """The longest start that is an expression, as postfix: prose may follow the expression on its line."""
    tokens = _TOKEN.findall(raw)
    end = depth = 0
    operand_next, names = True, _IDENTIFIER
    for k, t in enumerate(tokens):
        bare = t.rstrip(".") or t
        if bare != t:  # the end of a sentence
            tokens[k], t = bare, bare
            del tokens[k + 1 :]
        low = t.lower()
        # what needs an operand before it stands wrong where one is due, and the other way round
        if (t == ")" or low in _RANK) == operand_next:
            break
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
            if depth < 0:
                break
        elif low in _RANK:
            operand_next, names = True, _EXCEPTION if low == "with" else _IDENTIFIER
        elif names.fullmatch(low) or _named(tokens, k, names is _EXCEPTION):
            operand_next = False
        else:
            break
        if not operand_next and not depth:
            end = k + 1
    return to_postfix(tokens[:end]) if end else None


def _named(tokens: list[str], k: int, exception: bool) -> bool:
    """Whether a token that is of no known family is a name: one of ``NAMES``, or by its looks and what follows."""
    t, after = tokens[k], tokens[k + 1].lower() if k + 1 < len(tokens) else ")"
    if t.lower() in NAMES:
        return not exception
    if after != ")" and after not in _RANK:
        return False
    beside = k > 0 and tokens[k - 1].lower() in _RANK or after in _RANK
    return bool(_LIKE.fullmatch(t.lower())) or beside and bool(_CAPITALS.fullmatch(t))


def read_expression(raw: str) -> frozenset[frozenset[str]] | None:
    """Choices of the longest readable start."""
    postfix = readable_start(raw)
    return choices(postfix) if postfix else None


def label_of(identifier: str) -> str:
    name = _IDENTIFIER.fullmatch(identifier)
    return FAMILIES[name[1]] if name and name[1] else identifier


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def look(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, n_tags, n_choices, score."""
    words = word_bytes(text)
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, more, tags = [], set(), 0, []
    word = at = 0
    for end, phrase in _automaton().iter(joined):
        start = end - len(phrase) - 1
        if phrase in BASE or phrase == TAG:
            # ends grow, but a longer phrase may start before the last one that was counted
            word = word + joined.count(" ", at, start) if start >= at else word - joined.count(" ", start, at)
            at = start
        if phrase in BASE:
            base.append((word, BASE[phrase]))
        elif phrase == TAG:
            tags.append(word + TAG.count(" "))
        else:
            more += 1
            labels.add(NOTICES[phrase])
    n_tags = n_choices = 0
    if tags:
        ends = [m.end() for m in _RAW_WORD.finditer(text)]
        for last in tags:
            found = _EXPRESSION.match(text, ends[last])
            postfix = readable_start(found[1]) if found else None
            if postfix:
                names, ways = operands(postfix)
                n_tags += 1
                n_choices = min(n_choices + ways, MOST)
                labels |= {label_of(x) for x in names}
    base_labels = {label for _, label in base}
    starts = [w for w, _ in base]
    evidence = len(base) + more + 3 * n_tags
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | labels)), n_tags, n_choices, 1 - 0.5 ** min(evidence, 50),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what ``look`` tells: one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        for b in batches:
            columns = list(zip(*map(look, b.column("text").to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)
