from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import DOCS, documents

from ledgertree.llm import pu_quality as pu
from ledgertree.llm.quality_rules import FEATURES, statistics
from ledgertree.llm.registry import ship

SF_DIR = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def blobs(seed, n, share):
    """Rows of two kinds that differ in three statistics, and which are good."""
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    rows = r.normal(size=(n, len(FEATURES)))
    rows[:, :3] += np.where(good, 2.0, -2.0)[:, None]
    return rows, good


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_and_risk_on_known_mixtures(share):
    rows, good = blobs(1, 8000, share)
    positive = blobs(2, 3000, 1.1)[0]
    model = pu.fit(positive, rows)
    assert model.prior == pytest.approx(share, abs=0.07)
    fresh, truth = blobs(3, 4000, share)
    score = model.score(fresh)
    assert ((score >= 0.5) == truth).mean() > 0.97
    assert score.min() >= 0 and score.max() <= 1


def test_scores_are_the_sum_of_the_cuts_below():
    rows, _ = blobs(4, 500, 0.5)
    model = pu.fit(rows[:100], rows)
    marks = pu.indicators(rows, model.cuts)
    assert np.allclose(model.score(rows), pu._sigmoid(marks @ model.weight + model.bias), atol=1e-6)


def test_risk_by_definition():
    zp, zu = np.array([0.5, -1.0, 3.0]), np.array([2.0, -0.3])
    loss = lambda z: np.log(1 + np.exp(-z))
    positive, negative = pu.non_negative_risk(zp, zu, 0.4)
    assert positive == pytest.approx(0.4 * loss(zp).mean())
    assert negative == pytest.approx(loss(-zu).mean() - 0.4 * loss(-zp).mean())


def test_labels_of_held_out_rows_and_label_0_are_not_read(spark):
    ship(spark)
    docs = documents(spark, [f"{'word ' * (i % 50)}{i}" for i in range(200)])
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    base = [(i, 1, 0) for i in range(0, 200, 3) if i not in out]
    noise = [(i, i % 2, 0) for i in out] + [(None, 1, 0), (999, 1, 0), (1, None, 0), *((i, 0, 0) for i in range(1, 200, 3))]
    samples = [pu.training_sample(docs, spark.createDataFrame(x, LABELS)) for x in (base, base + noise)]
    assert all(np.array_equal(x, y) for x, y in zip(*samples, strict=True))
    assert len(samples[0][0]) == len(base) and len(samples[0][1]) == 200 - len(out)
    limited = pu.training_sample(docs, spark.createDataFrame(base, LABELS), sample=20)
    assert [len(x) for x in limited] == [20, 20]


def test_edge_rows(spark):
    ship(spark)
    texts = [None, "", "word", "x" * 100_000, "many words " * 30_000, *(f"some good text number {i} here " * 9 for i in range(60))]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(
        spark.createDataFrame([(None, "no id", None, None, None)] * 2, DOCS)
    )
    docs = docs.selectExpr("*", *(f"1 as {c}" for c in "held_out score predicted good label x log_words quality _id".split()))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5, 60)] * 2, LABELS)
    rows = pu.scored(docs, pu.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in rows)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    for i in (None, 0, 1, 2):
        assert len({(x.score, x.predicted) for x in rows if x.doc_id == i}) == 1
    none = pu.train(docs, labels.limit(0))
    assert none is None and {x.score for x in pu.scored(docs, none).collect()} == {0.5}
    assert pu.scored(docs.limit(0), none).collect() == [] and pu.train(docs.limit(0), labels) is None


def test_held_out_accuracy(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{x}.parquet") for x in ("documents", "labels"))
    model = pu.train(docs, labels)
    again = pu.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weight, again.weight) and model.prior == again.prior
    found = pu.scored(docs, model).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    rank = np.searchsorted(np.sort(bad.score), good.score).mean() / len(bad)
    assert rank > 0.99 and (found.predicted == found.quality).mean() > 0.98
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.06
    assert model.prior == pytest.approx(found.quality.mean(), abs=0.05)


def test_statistics_need_no_label():
    assert statistics([b"", b"a b"])[1].shape == (2, len(FEATURES))
