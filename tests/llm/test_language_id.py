from __future__ import annotations

import itertools
import zlib

import numpy as np
from helpers import documents

from ledgertree.llm import language_id
from ledgertree.llm.arrays import chunks
from ledgertree.llm.registry import ship

SF_DIR = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    r = np.random.RandomState(1)
    doc = np.array([0, 0, 0, 2, 2, 3])
    scores, moves = r.standard_normal((6, 3)), r.standard_normal((3, 3))
    steps = np.zeros((3, 3))
    got = language_id.marginals(scores, doc, 4, moves, steps)
    expected, expected_steps = np.zeros((6, 3)), np.zeros((3, 3))
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product(range(3), repeat=len(at)))
        weight = np.array(
            [
                np.exp(sum(scores[i, y] for i, y in zip(at, p, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
                for p in paths
            ]
        )
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for i, y in zip(at, p, strict=True):
                expected[i, y] += w
            for a, b in itertools.pairwise(p):
                expected_steps[a, b] += w
    assert np.allclose(got, expected) and np.allclose(steps, expected_steps)


def test_held_out_accuracy_and_mixed_text(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(known)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].lang_pred == known[i] for i in out]) > 0.97
    # A text that switches language is labelled word by word.
    by = {x: next(r.text for r in docs.filter(f"lang = '{x}'").collect() if "|" not in r.text and len(r.text.split()) > 100) for x in ("en", "de")}
    text = " ".join(by["en"].split()[10:40] + by["de"].split()[10:40]).encode()
    tokens = language_id.Tokens([text])
    p = language_id.marginals(model.emissions(tokens)[tokens.kind], tokens.doc, 1, model.transitions)
    got = np.array(model.languages)[p.argmax(axis=1)]
    assert (got[:25] == "en").mean() > 0.9 and (got[-25:] == "de").mean() > 0.9


def test_edge_cases(spark):
    ship(spark)
    docs = documents(spark, ["the words of it", None, "", "12 34 !!", "ß", "the words of it"])
    model = language_id.train(docs)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(docs, model).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0)
    assert rows[0] == rows[5] and rows[0][0] == rows[4][0] == "en"
    assert language_id.train(docs.limit(0)) is None
    nothing = language_id.predicted(docs, None).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == 6
    assert language_id.predicted(docs.limit(0), model).collect() == []


def test_long_text_alone():
    texts = ["ab " * 2_000_000, "x"]
    assert [len(part) for _, part in chunks(texts)] == [1, 1]
