from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from helpers import DOCS, corpus, documents, words

from ledgertree.llm import period_queries
from ledgertree.llm.periodic_runs import COVER, MODULUS, Extensions, find_runs, periodic_runs, scan
from ledgertree.llm.registry import ship


def brute_runs(w, least=12):
    """By definition: of each stretch that keeps a period, whether a smaller one does too."""
    out, n = [], len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(least, 2 * p):
                stretch = w[s : s + length]
                if all(stretch[q:] != stretch[:-q] for q in range(1, p)):
                    out.append((s, length, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """The contract word by word."""
    w = words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    exponent = 1000 * best[1] // best[2] if runs else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, exponent, *digest)


def periodic(r, size, letters=3):
    out = []
    while len(out) < size:
        unit = [r.choice("abcde"[:letters]) for _ in range(r.randint(1, 9))]
        out += (unit * r.randint(1, 8))[: r.randint(1, 60)]
    return out[:size]


def test_cover_has_all_differences():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_against_direct_comparison():
    r = random.Random(1)
    for size in (1, 2, 30, 31, 32, 100, 400):
        ids = np.array([ord(x) for x in periodic(r, size)])
        longest = Extensions(ids)
        pairs = [(i, j) for i in range(size) for j in range(i + 1, size + 1)]
        pairs = r.sample(pairs, min(len(pairs), 3000))
        got = longest(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        for (i, j), n in zip(pairs, got.tolist(), strict=True):
            k = 0
            while j + k < size and ids[i + k] == ids[j + k]:
                k += 1
            assert n == k


def test_runs_against_definition():
    r = random.Random(2)
    for _ in range(150):
        w = periodic(r, r.randint(0, 200), r.choice([1, 2, 3, 5]))
        ids = np.array([ord(x) for x in w], dtype=np.uint32)
        assert list(zip(*(x.tolist() for x in find_runs(ids, len(ids))), strict=True)) == brute_runs(w)


def test_runs_never_cross_texts():
    sizes, runs, left = scan([b"a b a b a b", b"", b"a b a b a b", b"", b"x " * 11, b"x\ty " * 6])
    assert sizes.tolist() == [6, 0, 6, 0, 11, 12]
    assert [x.tolist() for x in runs] == [[5], [0], [12], [2]] and left[5] == b"x y" and left[4] == b" ".join([b"x"] * 11)


def test_long_runs_and_long_texts():
    n = 60_000
    assert [x.tolist() for x in find_runs(np.ones(n, np.uint32), n)] == [[0], [n], [1]]
    half = np.random.default_rng(3).permutation(n).astype(np.uint32) + 1
    assert [x.tolist() for x in find_runs(np.tile(half, 2), 2 * n)] == [[0], [2 * n], [n]]
    assert len(find_runs(half, n)[0]) == 0


def test_query_against_brute_force(spark):
    ship(spark)
    r = random.Random(4)
    texts = corpus(3, 80, 120) + [" ".join(periodic(r, r.randint(1, 150))) for _ in range(80)]
    texts += ["a\x0bb\x0c" * 8, "x " * 4000, "é　é　é é", "ab ab ab " * 20]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id < 4")).unionByName(
        spark.createDataFrame([(None, "q r " * 30, None, None, None), (None, None, None, None, None)], DOCS)
    )
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    found = period_queries.digests(periodic_runs(period_queries.cycled(docs)))
    got = sorted((tuple(x) for x in found.collect()), key=str)
    assert got == sorted((brute_row(*x) for x in rows), key=str)
    assert period_queries.digests(periodic_runs(period_queries.cycled(docs.limit(0)))).collect() == []


def test_clashing_columns(spark):
    ship(spark)
    docs = documents(spark, ["a b " * 12, None, ""])
    docs = docs.selectExpr("*", *(f"1 as {c}" for c in "runs collapsed n_words words h g a p _id greatest start length".split()))
    got = {x.doc_id: (x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs(docs).collect()}
    assert got == {0: (24, [(0, 24, 2)], "a b"), 1: (0, [], ""), 2: (0, [], "")}
    assert period_queries.cycled(docs).count() == 3
