from __future__ import annotations

import random

import pytest
from helpers import DOCS, corpus, documents
from pyspark.sql import functions as F

from ledgertree.llm import suffix_dedup
from ledgertree.llm.registry import ship


def brute(texts, n=100):
    seen, out = set(), {}
    for d, text in enumerate(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            if data[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(data[i : i + n])
        runs = bytes(gone).replace(b"\0", b" ").split()
        out[d] = (len(data), sum(gone), len(runs), bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def periodic(seed):
    r = random.Random(seed)
    out = []
    for _ in range(30):
        unit = "".join(r.choice("ab\0é") for _ in range(r.randint(1, 7)))
        out.append("".join(r.choice(["x", unit * r.randint(1, 80), "\0" * r.randint(0, 150)]) for _ in range(r.randint(1, 5))))
    return out


def passages(seed):
    """One passage in every text, so that its edges are hot."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    common = word(260)
    return [word(r.randint(0, 200)) + common + word(r.randint(0, 200)) for _ in range(60)]


@pytest.mark.parametrize(
    ("make", "hot"),
    [
        (lambda: corpus(1, 90, 120), 4000), (lambda: periodic(2), 4000), (lambda: passages(3), 4000),
        (lambda: passages(4), 5), (lambda: corpus(5, 90, 120), 1),
    ],
)
def test_against_all_strings(spark, monkeypatch, make, hot):
    ship(spark)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = make()
    docs = documents(spark, texts).repartition(5)
    assert found(suffix_dedup.deduplicated(docs)) == brute(texts)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    text = "".join(random.Random(6).choice("abc") for _ in range(2000)).encode()
    rows = [suffix_dedup.parse(p) for p in suffix_dedup.pieces([(0, 0, text)])]
    starts = sorted(s + k for r in rows for s, n in zip(r["start"], r["strings"], strict=True) for k in range(n))
    assert starts == list(range(len(text) - 99))


def test_empty_table(spark):
    ship(spark)
    assert found(suffix_dedup.deduplicated(documents(spark, ["a"]).limit(0))) == {}


def test_rows_of_one_id_and_of_none_against_all_strings(spark):
    ship(spark)
    r = random.Random(8)
    word = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    common, other = word(150), word(400)
    texts = [common + word(90), word(60) + common, other, other, common + word(30), word(200) + other[50:300], None, ""]
    ids = [None, None, None, 7, 7, 7, None, 7]
    rows = list(zip(ids, texts, strict=True)) + [(7, other), (9, word(120)), (None, texts[0]), (5, word(40) + common)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    # The order that the operator states: null ids first, rows of one id by the hash of their text.
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    unsigned = lambda h: h % (1 << 64)
    place = {(x.doc_id, x.text): (x.doc_id is not None, x.doc_id or unsigned(x.h) >> 2, unsigned(x.h) % (1 << 32)) for x in hashed}
    order = sorted(place, key=place.get)
    expected = dict(zip(order, brute([t for _, t in order]).values(), strict=True))
    got = suffix_dedup.deduplicated(docs.repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    got = sorted(((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept))) for x in got), key=str)
    assert got == sorted(((i, expected[i, t]) for i, t in rows), key=str)
    assert sum(x[1][1] for x in got) > 800
