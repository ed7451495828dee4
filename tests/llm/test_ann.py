from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertree.llm import ann
from ledgertree.llm.registry import ship

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=20):
    """Nearest of each query by exact search over one vector per id."""
    good = {
        i: np.array(v, dtype=np.float64)
        for i, v, _ in rows
        if i is not None and v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)
    }
    out = {}
    for q, x in good.items():
        if q % every == 0:
            ranked = sorted((-float((x * y).sum()), i) for i, y in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def rows(count, seed=0):
    r = np.random.RandomState(seed)
    out = [(i, [float(np.float32(c)) for c in r.standard_normal(16) * (1 + i % 3)], 0) for i in range(count)]
    copy = out[3][1]
    out += [(1000 + i, copy, 0) for i in range(50)]
    out += [(2000, None, 0), (2005, [0.0] * 16, 0), (2010, [1.0, None] + [0.0] * 14, 0), (2015, [float("nan")] * 16, 0)]
    out += [(2020, [float("inf")] * 16, 0), (2025, [1.0] * 5, 0), (None, [1.0] * 16, 0), out[5], out[10]]
    return out


def test_small_table_is_exact(spark):
    ship(spark)
    data = rows(200)
    got = found(ann.search(spark.createDataFrame(data, SCHEMA).repartition(5), F.col("vec_id") % 5 == 0))
    expected = brute(data, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    for q, v in expected.items():
        assert np.allclose([s for _, s in v], [s for _, s in got[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("count", [0, 1, 7])
def test_few_rows(spark, count):
    ship(spark)
    data = rows(20)[:count]
    got = found(ann.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 1 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {
        q: [i for i, _ in v] for q, v in brute(data, 1).items() if v
    }


def test_recall_on_vectors_without_clusters(spark):
    ship(spark)
    r = np.random.RandomState(1)
    x = r.standard_normal((5000, 16)).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = found(ann.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0))
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 5000, 50):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits / 2000 >= 0.9


def test_abandoning_loses_little():
    r = np.random.RandomState(2)
    x, q = r.standard_normal((3000, 64)), r.standard_normal((20, 64))
    turn, _ = np.linalg.qr(r.standard_normal((64, 64)))
    score = q @ x.T
    bar = np.sort(score, axis=1)[:, -10]
    who, row, got = ann.scan(x, x @ turn, np.arange(3000), q, q @ turn, bar, 10)
    right = {(i, int(j)) for i in range(20) for j in np.argsort(-score[i])[:10]}
    assert len(right & set(zip(who.tolist(), row.tolist(), strict=True))) >= 190
    assert np.allclose(got, score[who, row])
