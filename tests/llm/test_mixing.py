from __future__ import annotations

import compare
import duckdb
import pytest
from helpers import corpus, documents, words

from ledgertree.llm import mixing
from ledgertree.llm.mixing_queries import _check
from ledgertree.llm.registry import QUERIES, ship


def shares(sizes):
    """Targets by sharing out again and again."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < left * weight[s] / total}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_against_sql(spark):
    con = compare.connect("/root/testdata/sf0.001")
    assert compare.differences(spark, con, "op3_mixing", QUERIES["op3_mixing"], _check(), "/root/testdata/sf0.001") == []


def test_targets_and_limits(spark):
    ship(spark)
    texts = corpus(3, 200) + ["w " * 5000, "tiny"]
    docs = documents(spark, texts).withColumnRenamed("lang", "size").union(
        spark.createDataFrame([(900, "only one source here", "x", "zz", 1), (900, "only one source here", "x", "zz", 1)],
                              "doc_id long, text string, lang string, source string, n_chars long")
    )
    rows = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken_words(docs).collect()), key=str)
    assert len(rows) == docs.count()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id < 900:
            assert r.size == len(words(texts[r.doc_id]))
    expected = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source], rel=1e-12)
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK + 0.01 * t


def test_permutation_is_one_to_one(spark):
    for n, seed in ((1, 0), (2, 3), (1000, 5), (4097, 1)):
        df = spark.range(n).selectExpr("id as x", f"{n}L as n", f"{seed}L as seed")
        got = [r.y for r in mixing.permuted(df, "x", "n", "seed", "y", 1).orderBy("x").collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or sum(a == i for i, a in enumerate(got)) < n / 50


def test_slots_and_shards(spark):
    ship(spark)
    table = mixing.sources(mixing.sized(documents(spark, corpus(5, 300))))
    mix = mixing.slots(table, shard_slots=16).collect()
    total = sum(r.slots for r in table.collect())
    assert sorted(r.slot for r in mix) == list(range(total))
    blocks = {r.sid: r.blocks for r in table.collect()}
    assert all(0 <= r.block < blocks[r.sid] and r.shard == r.slot // 16 for r in mix)
    counts = mixing.shard_counts(mixing.slots(table, shard_slots=16)).collect()
    assert sum(r.n_slots for r in counts) == total and len({r.n_slots for r in counts}) > 1


def test_mixed_and_empty(spark):
    ship(spark)
    docs = documents(spark, corpus(6, 100))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in mixing.taken_words(docs).collect():
        low = r.taken // r.size if r.size else 0
        assert low <= times.get(r.doc_id, 0) <= low + bool(r.size and r.taken % r.size)
    assert mixing.taken_words(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    nothing = mixing.taken_words(documents(spark, [None, ""])).collect()
    assert {(r.size, r.taken, r.target) for r in nothing} == {(0, 0, 0.0)}
    assert duckdb.__version__


def test_mixed_meets_targets_with_long_texts(spark):
    ship(spark)
    # A hot source that is to give about a quarter of its words, and two to be repeated.
    rows = [(i, f"w{i} " * 1500, "en", "a" if i % 10 < 6 else "bc"[i % 2], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    share = {r.doc_id: r.taken / r.size for r in mixing.taken_words(docs).collect()}
    times = dict.fromkeys(share, 0)
    for r in mixing.mixed(docs.repartition(7)).collect():
        times[r.doc_id] += 1
    assert all(int(x) <= times[i] <= int(x) + 1 for i, x in share.items())
    for source, target in shares({"a": 540 * 1500, "b": 180 * 1500, "c": 180 * 1500}).items():
        words_of = 1500 * sum(times[i] for i, _, _, s, _ in rows if s == source)
        assert words_of == pytest.approx(target, rel=0.15)
    assert sorted(r.doc_id for r in mixing.mixed(docs).collect()) == sorted(i for i, n in times.items() for _ in range(n))


def test_mixed_keeps_null_ids(spark):
    ship(spark)
    # Equal shares of 1, 2 and 3 epochs at most: the third source is taken twice or more.
    rows = [(None if s == "c" else k, f"{s}{k} " * 640, "en", s, 0) for s in "abc" for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = sum(r.taken for r in mixing.taken_words(docs).collect() if r.source == "c")
    got = [r.text.split()[0] for r in mixing.mixed(docs).collect() if r.doc_id is None]
    assert 640 * len(got) == pytest.approx(taken, rel=0.35) and len(set(got)) == 20
