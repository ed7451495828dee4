from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from helpers import DOCS, corpus, documents, lowered, words

from ledgertree.llm import ngram_join
from ledgertree.llm.registry import ship


def shingles(text, n=4):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(texts, n=4, percent=85):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {i: (len(sets[i]), root[i], links[i]) for i in range(len(texts))}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize(("seed", "leaf"), [(1, 1500), (2, 3)])
def test_against_all_pairs(spark, seed, leaf):
    ship(spark)
    texts = corpus(seed, count=160, size=90)
    docs = documents(spark, texts).repartition(5)
    assert found(ngram_join.classes(docs, leaf)) == brute(texts)


def test_tiles_lose_no_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 60))
        base = r.integers(0, 1 << 62, n + 10, dtype=np.int64).astype(np.uint64)
        a = np.unique(base[:n])
        b = np.unique(np.concatenate((base[int(r.integers(0, 3)) : n], base[n : n + int(r.integers(0, 5))])))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        tile, owner = ngram_join.tiles(np.array([len(a), len(b)]), np.concatenate((a, b)))
        same = len(a) == len(b) == both
        assert same or set(tile[owner == 0].tolist()) & set(tile[owner == 1].tolist())


@pytest.mark.parametrize("percent", [80, 85])
def test_points_leave_every_link_and_few_others(percent):
    r = np.random.default_rng(5)
    sets = []
    for size in (3, 40, 300, 1100, 5000, 9000):
        for _ in range(20):
            own = r.integers(0, 1 << 62, int(size * r.uniform(0.8, 1.2)) + 1, dtype=np.int64).astype(np.uint64)
            sets.append(np.unique(own))
            if r.random() < 0.2:
                keep = own[: max(1, int(len(own) * r.uniform(0.75, 1)))]
                sets.append(np.unique(np.concatenate((keep, r.integers(0, 1 << 62, len(own) // 40, dtype=np.int64).astype(np.uint64)))))
    order = r.permutation(len(sets))
    sets = [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    packed = ngram_join.points(n, np.concatenate(sets))
    side = r.integers(0, 2, len(sets))
    linked = {
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (n[i] + n[j] - both)
    }
    assert len(linked) > 5
    for sides in (np.zeros(len(sets), np.int64), side):
        two = sides.min() != sides.max()
        wanted = {x for p in linked if not two or sides[p[0]] != sides[p[1]] for x in p}
        got = set(np.flatnonzero(ngram_join.with_partner(n, packed, sides, bool(two), percent)).tolist())
        assert wanted <= got
        # Sets of hundreds of shingles that have nothing in common are told apart.
        for i in got - wanted:
            assert n[i] < 200 or any(len(np.intersect1d(sets[i], s)) > n[i] / 2 for j, s in enumerate(sets) if j != i)


def test_empty_table_and_one_of_each(spark):
    ship(spark)
    texts = corpus(4, count=40)
    docs = documents(spark, texts)
    assert found(ngram_join.classes(docs.limit(0))) == {}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute(texts).items() if v[1] == i}


def test_pipeline_joins_at_five_words_and_80_percent(spark):
    ship(spark)
    base = [f"w{i}" for i in range(94)]
    # Two scattered edits: 80 of 100 five-word shingles are common, 83 of 99 four-word ones.
    edited = [{30: "x", 60: "y"}.get(i, w) for i, w in enumerate(base)]
    # A third one is too many for both.
    far = [{30: "p", 60: "q", 75: "r"}.get(i, w) for i, w in enumerate(base)]
    docs = documents(spark, [" ".join(base), " ".join(edited), " ".join(far), "other words that stand alone here"])
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 2, 3}
    links = {r.doc_id: r.n_links for r in ngram_join.classes(docs, 1, 5, 80).collect()}
    assert links == {0: 1, 1: 1, 2: 0, 3: 0}


def test_null_ids(spark):
    ship(spark)
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(5, long[0]), (None, long[0] + " x"), (None, long[1]), (None, long[1]), (None, long[1] + " y"), (None, ""), (7, long[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    found = sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in ngram_join.classes(docs).collect())
    assert found == [(0, 0, 0), (0, 0, 2), (0, 0, 2), (0, 0, 2), (0, 5, 1), (5, 5, 1), (7, 7, 0)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text[:2]) for r in kept.collect()]
    assert sorted(kept, key=str) == sorted([(5, "a0"), (None, "b0"), (None, ""), (7, "c0")], key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_share_no_tiles(percent):
    r = np.random.default_rng(6)
    sizes = np.concatenate([r.integers(n * 3 // 4, n, 60) for n in (300, 800, 3000)])
    value = r.integers(0, 1 << 62, int(sizes.sum()), dtype=np.int64).astype(np.uint64)
    tile, _ = ngram_join.tiles(sizes, value, percent)
    assert len(np.unique(tile)) == len(tile)


def test_linked_sets_share_as_many_tiles_as_they_need():
    r = np.random.default_rng(7)
    linked = 0
    for _ in range(300):
        n = int(r.integers(5, 400))
        base = r.integers(0, 1 << 62, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[int(n * r.uniform(0, 0.2)) : n + int(n * r.uniform(0, 0.1))])
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        linked += 1
        tile, owner, need = ngram_join.tiles(np.array([len(a), len(b)]), np.concatenate((a, b)), 80, needs=True)
        common = np.isin(tile, tile[owner == 0]) & np.isin(tile, tile[owner == 1])
        # Of one of the levels both sets have tiles of.
        assert any(
            (common & (owner == 0) & (need == x)).sum() >= x >> 1 and (common & (owner == 1) & (need == y)).sum() >= y >> 1
            for x in set(need[common & (owner == 0)].tolist())
            for y in set(need[common & (owner == 1)].tolist())
        )
    assert linked > 50


def test_tree_joins_all_that_may_link():
    r = np.random.default_rng(8)
    sets = []
    for _ in range(6):
        own = r.integers(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
        sets += [np.unique(np.concatenate((own[: int(r.integers(330, 400))], own[:300]))) for _ in range(120)]
    sets = [sets[i] for i in r.permutation(len(sets))]
    n = np.array([len(s) for s in sets])
    tree = []
    alive = ngram_join.with_partner(n, ngram_join.points(n, np.concatenate(sets)), np.zeros(len(n), int), False, 80, tree)
    root = list(range(len(n)))
    for a, b in tree:
        assert root[a] != root[b]
        root = [root[a] if x == root[b] else x for x in root]
    assert alive.all()
    assert len(set(root)) == 6
    assert all(len(np.intersect1d(sets[i], sets[root[i]])) >= 300 for i in range(len(n)))


def test_common_phrases_do_not_make_clusters(spark):
    ship(spark)
    r = np.random.default_rng(9)
    phrases = [" ".join(f"p{i}x{k}" for k in range(6)) for i in range(12)]
    texts = []
    for d in range(240):
        own = [f"d{d}w{k}" for k in range(int(r.integers(150, 300)))]
        for at in sorted(r.integers(0, len(own), 6).tolist(), reverse=True):
            own[at:at] = [phrases[int(r.integers(len(phrases)))]]
        texts.append(" ".join(own))
    near = [t.replace(f"d{d}w50 ", "other ") for d, t in enumerate(texts[:9])]
    docs = documents(spark, texts + near).repartition(3)
    edges = [{r.a, r.b} for r in ngram_join.tile_edges(docs, 5, 80).collect()]
    # Common phrases would add hundreds.
    assert 9 <= len(edges) <= 12
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found(ngram_join.classes(docs, 2, 5, 80)) == brute(texts + near, 5, 80)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
