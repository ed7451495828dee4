from __future__ import annotations

from collections import Counter

import numpy as np
from helpers import corpus, documents, words

from ledgertree.llm import quality_rules as q
from ledgertree.llm.registry import ship

SF_DIR = "/root/testdata/sf0.01"


def brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    cover = {k for i, x in enumerate(windows) if times[x] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover))


def test_counts(spark):
    ship(spark)
    texts = corpus(7, 120) + ["a b c d e f g h " * 9, "x\nx\n\n \nx y\nx", "#*$%&|<> <>", "one two three four five six seven eight " * 2]
    rows = {r.doc_id: r for r in q.judged(documents(spark, texts).repartition(3), None).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n = brute(text)
        assert tuple(rows[i][c] for c in q.COUNTS) == n
        assert rows[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert rows[i].kept == (not rows[i].base_failed)


def test_scores_never_rise_with_falling_features():
    r = np.random.RandomState(1)
    rows = r.random_sample((3000, len(q.FEATURES)))
    good = (rows.sum(axis=1) + r.standard_normal(3000) > len(q.FEATURES) / 2).astype(float)  # rises with all
    model = q.fit(rows, good)
    for name in q.FALLING:
        f = q.FEATURES.index(name)
        grid = np.repeat(rows[:50], 20, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(model.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()
    assert model.score(rows)[good > 0].mean() > model.score(rows)[good == 0].mean() + 0.1


def test_flat_trees_against_a_walk():
    r = np.random.RandomState(2)
    rows = r.random_sample((400, len(q.FEATURES)))
    model = q.fit(rows, (rows[:, 0] > rows[:, 3]).astype(float), trees=5)
    for row, got in zip(rows[:50], model.score(rows[:50]), strict=True):
        total = model.bias
        for t in range(5):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.cut[t, node] else 1)
            total += model.value[t, node]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_held_out_labels(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = q.judged(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == q.judged(docs, model).filter("kept").count()


def test_edge_cases(spark):
    ship(spark)
    docs = documents(spark, [None, "", "word " * 30])
    labels = spark.createDataFrame([(2, None), (2, 5), (None, 1)], "doc_id long, quality int")
    assert q.train(docs, labels) is None
    assert [r.kept for r in q.judged(docs, None).orderBy("doc_id").collect()] == [False, False, False]
    assert q.judged(docs.limit(0), None).collect() == []
