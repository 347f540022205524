"""Operators 11 to 13 against brute force on the smallest table and on odd rows."""

import hashlib
from collections import Counter
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import pairs
from tidemark.llm import alignment, audit, bloom, decontaminate, jaccard, packing, sharding, simhash, toxicity


def tables():
    return pytest.mark.parametrize("table", ["docs", "odd", "no_docs"])


# 11 filter interaction audit


def fails(text, repeated):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    upper = sum("A" <= c <= "Z" for c in text)
    told = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": repeated}
    return {k for k, v in told.items() if v}


@tables()
def test_audit(table, request, labels):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text or "", r.source or "") for r in df.select("doc_id", "text", "source").collect()]
    told = labels.collect()
    good, toxic = ({r.doc_id for r in told if r[c] == 1} for c in ("quality", "toxic"))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    expected = {}
    for part in {p for _, _, p in rows}:
        own = [(i, fails(t, i is not None and least[t] < i)) for i, t, p in rows if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [i for i, x in own if f in x and not x & before]
                removed_by[f] += len(gone)
                expected[part, order, step] = [
                    sum(not x & (before | {f}) for _, x in own), len(gone), sum(f in x and bool(x & before) for _, x in own),
                    sum(x == {f} for _, x in own), sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
        for (p, order, step), row in expected.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    got = {(r.part, r.filter_order, r.step): [r[x] for x in audit.OUTCOMES] for r in audit.audit(df, labels).collect()}
    assert got == expected


def test_audit_equals_sql(spark, sf_dir, docs, labels):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel, got = con.sql(audit.ORACLE), audit.audit(docs, labels)
    assert rel.columns == got.columns
    assert sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))


def test_audit_of_many_copies_and_labels(spark):
    """A text that most rows share, in several parts; a label that is there twice and one without an id; a null part."""
    rows = [(i, "same", None if i % 3 else "p") for i in range(300)] + [(None, "same", "p"), (5, "same", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.part: r for r in audit.audit(docs, labels).filter("filter_order = 'EABCD' AND step = 1").collect()}
    assert (got[""].removed, got[""].kept) == (200, 0)
    assert (got["p"].removed, got["p"].kept) == (100, 2)  # doc 0 and the row without an id; 5 is a repeat of 0
    assert (got[""].good_lost, got[""].toxic_lost) == (1, 1)
    none = audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(none) == (0, 0)


def test_outcomes_add_up():
    pairs_, by = audit.outcome_matrices("ABCDE")
    assert len(pairs_) == 600 and all(m.shape == (32, 600) for m in by.values())
    last = [k for k, (_, step) in enumerate(pairs_) if step == 5]
    # what no filter removes is kept to the end, and each mask but none is removed once in each order
    assert by["kept"][:, last].sum(axis=1).tolist() == [120] + [0] * 31
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all()


# 12 cross-tokenizer alignment


def aligned_by_bytes(texts):
    """Whole texts, each byte offset by itself."""
    both = alignment.Tokenizers(*alignment.paths())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found, counts = [], Counter()
    for t in texts:
        a = both.a.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        parts = [[bytes(bytes_of[c] for c in both.a.id_to_token(i)) for i in a], [both.bytes_b[i] for i in b]]
        if not t or any(b"".join(p) != f" {t}".encode() for p in parts):
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(i, j) for i, e in zip(a, ends[0]) for j, f in zip(b, ends[1]) if e == f]
        groups = ["|".join(",".join(str(i) for i, e in zip(ids, end) if lo < e <= hi) for ids, end in zip((a, b), ends)) for lo, hi in zip([0, *cuts], cuts)]
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4])
        for f in found
    ]


ODD_TEXTS = [
    " ", "  ", "\n", " \n a", "a ", "a\n", "a  b\t c\n\n d", "x" * 3000, "a▁b", "<|endoftext|> <s> </s>", "\r\nfoo();\r\n  bar", "é\xa0b  c",
    "\x1cx \x85y", "don't  we'll 123 4\x00", "日本語 テスト\n中文", "😀 á ﬁ ａ", "\t\tx", "a \nb", "​x ﻿y", "　wide  line",
]


@tables()
@pytest.mark.parametrize(("frequent", "sent"), [(3, 10), (400_000, 400_000)])
def test_alignment(table, frequent, sent, request, spark):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    if table == "odd":
        rows = [(i, t and t[:4000]) for i, t in rows] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS * 2)]
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, stretch string, n long")
    elif table == "docs":
        rows, df = rows[:60], spark.createDataFrame(rows[:60], "doc_id long, text string")
    expected = Counter((i, *f) for (i, _), f in zip(rows, aligned_by_bytes([t for _, t in rows])))
    assert Counter(map(tuple, alignment.report(df, frequent=frequent, pairs_sent=sent, shapes_sent=sent).collect())) == expected


def test_links_are_of_id_pairs(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    both = alignment.Tokenizers(*alignment.paths())
    the = (both.a.encode(" the").ids[0], both.b.encode("the")[0])
    got = {(r.a, r.b): (r.n_linked, r.is_best) for r in alignment.links(alignment.aligned(df)).collect()}
    assert got[the] == (2, True)


# 13 n-gram Jaccard join


def plain_sets(texts):
    found = []
    for t in texts:
        words = (t or "").encode().lower().split()
        found.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())
    return found


def joined(rows):
    """(doc_id, n_shingles, component_id) of every row."""
    found = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        same = len(found[a] & found[b])
        if same and 100 * same >= 85 * (len(found[a]) + len(found[b]) - same):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(found[k]), least.get(top(k))) for k, (i, _) in enumerate(rows))


@tables()
@pytest.mark.parametrize("block", [2_000, jaccard.BLOCK])
def test_jaccard(table, block, request):
    df = request.getfixturevalue(table)
    assert Counter(map(tuple, jaccard.report(df, block).collect())) == joined(pairs(df))


@pytest.mark.parametrize("block", [1_000, jaccard.BLOCK])
def test_copies_near_the_bound(spark, block):
    """Copies with so many words replaced that some pairs lie on either side of the bound; short texts; a passage that all share."""
    rng = np.random.default_rng(3)
    shared, rows = " ".join(f"s{k}" for k in range(60)), []
    for n in (3, 5, 8, 9, 12, 20, 30, 60, 150, 400):
        for origin in range(3):
            words = [f"w{rng.integers(10**6)}" for _ in range(n)]
            for _ in range(6):
                copy = list(words)
                for at in rng.choice(n, rng.integers(0, 1 + n // 40 + 1), replace=False):
                    copy[at] = f"x{rng.integers(10**6)}"
                rows.append((len(rows), " ".join(copy) + (f" {shared}" if origin == 2 and n > 60 else "")))
    rows += [(None, rows[0][1]), (3, rows[0][1]), (900, ""), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = joined(rows)
    assert len({c for _, _, c in expected}) < len(expected) - 50
    assert Counter(map(tuple, jaccard.report(df, block).collect())) == expected


def test_a_band_is_next_to_those_of_its_partners():
    low = jaccard.bands()
    for b in range(1, 5000):
        a = -(-85 * b // 100)
        assert np.searchsorted(low, a, side="right") >= np.searchsorted(low, b, side="right") - 1


@pytest.mark.parametrize("n", [6, 7, 8, 9, 10, 12, 15, 20, 25, 33, 50, 77, 120, 333, 1500])
def test_no_pair_within_the_bound_is_lost(n):
    rng = np.random.default_rng(n)
    for _ in range(150):
        a = np.unique(rng.integers(0, 1 << 64, size=n, dtype=np.uint64))
        size = int(rng.integers(n, 100 * n // 85 + 1))
        common = -(-85 * (n + size) // 185)
        if common > n:
            size, common = n, -(-170 * n // 185)
        new = rng.integers(0, 1 << 64, size=size - common, dtype=np.uint64)
        b = np.unique(np.concatenate([rng.choice(a, common, replace=False), new]))
        if jaccard.linked_sizes(n, size, common) and common < max(n, size):
            assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))


def test_bloom_filter(spark):
    keys = spark.range(0, 20_000, 1, 4).selectExpr("xxhash64(id) AS key")
    found = spark.range(40_000).selectExpr("id", "xxhash64(id) AS key")
    held = {r.id for r in found.filter(bloom.column(found, keys, 20_000, found["key"])).collect()}
    assert set(range(20_000)) <= held
    assert len(held) < 20_000 + 200
    assert bloom.words_for(10**12) == bloom.MOST and bloom.words_for(0) == bloom.LEAST


# bounds at scale


def test_rows_alike_are_spread(spark):
    """A third of all rows alike in all that sharding looks at."""
    n = sharding.RUN * 2 + 5
    df = spark.range(n).selectExpr("7L AS doc_id", "'same' AS text").unionByName(spark.range(100).selectExpr("id AS doc_id", "'x' AS text"))
    got = sharding.assign(df, 16, buckets=8).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in got) and sum(r["count(1)"] for r in got) == n + 100
    assert max(r["count(1)"] for r in got) - min(r["count(1)"] for r in got) <= 1


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_benchmark_in_blocks(spark, docs, benchmark, block):
    some = benchmark.limit(5)
    got = Counter(map(tuple, decontaminate.report(docs, some, block_windows=block).collect())) if block > 1 else None
    if got is None:
        some = some.selectExpr("item_id", "substring(text, 1, 60) AS text")
        got = Counter(map(tuple, decontaminate.report(docs, some, block_windows=3).collect()))
    assert got == Counter(map(tuple, decontaminate.report(docs, some).collect()))


def test_tasks_forget_long_words():
    encoder = packing.Encoder(packing.tokenizer_path())
    for k in range(4):
        list(encoder.encode([f"{chr(97 + k)}" * 30_000_000 if k % 2 else "short words"]))
        assert encoder.size < packing.CACHED_BYTES + 200_000_000
    model = toxicity.Model()
    for k in range(3):
        model.look(chr(97 + k) * 40_000_000)
    assert model.size <= toxicity.KNOWN_BYTES + 40_000_000 and len(model.met) <= 2


def test_groups_over_the_cap_are_split(spark):
    """Many fingerprints that share most masks, with a cap that most buckets break."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, size=(120, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.fp: r.root for r in simhash.components(simhash.links(df, cap=8)).collect()}
    root = {x: x for x in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    linked = {x for x in fps if any(x != y and (x ^ y).bit_count() <= 3 for y in fps)}
    assert got == {x: top(x) for x in linked}


def test_only_rows_that_go_are_marked(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "x y z"), (1, "a b c d e"), (None, "x y z"), (5, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, simhash.deduplicate(df).collect()))
    assert got == Counter({(1, "a b c d e"): 1, (3, "x y z"): 1, (5, "other words here"): 1})
