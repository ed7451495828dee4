"""Searches through the token tables give what a scan of all names gives."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.functions import text as X
from ledgertree.operators import search, token_index, tree

LONG_WORD = "abcdefghij" * 4


def named(spark, names, first=2):
    rows = [("C:", 1, 1, "C:", True, 0, models.T0, models.T0, 16)] + [
        ("CD"[i % 5 == 0] + ":", i, 1, n, False, i, models.T0, models.T0, 32) for i, n in enumerate(names, start=first)
    ]
    facts = spark.createDataFrame(rows, models.FACT_DDL)
    return search.build_documents(facts, tree.chains(tree.directories(facts)))


def stored(index, folder):
    out = {}
    for name in token_index.LAYOUT:
        df = getattr(index, name)
        df.sortWithinPartitions(*token_index.LAYOUT[name]).write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return token_index.TokenIndex(**out)


@pytest.fixture(scope="module")
def words():
    r = random.Random(4)
    return ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)] + [LONG_WORD, "x" + LONG_WORD, "é", "straße", "ab"]


@pytest.fixture(scope="module")
def docs(spark, words, tmp_path_factory):
    r = random.Random(5)
    names = [r.choice(["_", ".", " ", "-", ""]).join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(600)]
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    named(spark, [*names, "", "...", "ab ab ab.ab", "É_STRASSE"]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return stored(token_index.build(docs), str(tmp_path_factory.mktemp("index")))


def scored(df, tiers):
    kept = df.filter(sum((F.col(f"_{t}") for t in tiers), F.lit(0.0)) > 0)
    return sorted((r.uid, *[round(r[f"_{t}"], 6) for t in tiers]) for r in kept.collect())


def queries(words):
    r = random.Random(6)
    out = ["ab ab", "ab ab ab ab", "é", "straße ab", "a", ".", "ab.ab", LONG_WORD[:-1], LONG_WORD + "xy", "zz qq"]
    for _ in range(6):
        picked = [r.choice(words) for _ in range(r.randint(1, 3))]
        cut = r.randint(1, 6)
        out.append(" ".join(w[:cut] if r.random() < 0.3 else w for w in picked).upper())
    return out


def test_every_tier_against_the_scan(spark, docs, index, words):
    for query in queries(words):
        tiers = search.tier_weights(query)
        scan = docs.withColumns({f"_{t}": w for t, w in tiers.items()})
        assert scored(token_index.weighted(docs, index, query), list(tiers)) == scored(scan, list(tiers)), query


def test_search_through_the_index(docs, index, words):
    stats = search.term_stats(docs)
    for query in ("ab straße", words[0], "zz"):
        for bm25 in (False, True):
            arguments = dict(advanced=True, bm25=bm25, stats=stats, volume="C:", limit=50)
            plain, quick = (search.search(docs, query, index=x, **arguments) for x in (None, index))
            assert plain.columns == quick.columns
            assert list(map(str, plain.collect())) == list(map(str, quick.collect()))


def test_near_words_with_swaps_against_the_definition(spark, index):
    tokens = [r.token for r in index.tokens.collect()]
    r = random.Random(7)
    asked = []
    for _ in range(12):
        w = list(r.choice([t for t in tokens if len(t) > 2]))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w) - 1)
            kind = r.random()
            if kind < 0.5:
                w[i], w[i + 1] = w[i + 1], w[i]
            elif kind < 0.7:
                w[i] = "c"
            elif len(w) > 3:
                del w[i]
        asked.append("".join(w))
    for word in asked:
        limit = 2 if len(word.encode()) > 5 else 1
        want = {t for t in tokens if models.edit_distance(t, word) <= limit}
        assert {x.token for x in token_index.near(index, word).collect()} == want, word


def test_names_are_read_by_key_alone(docs, index):
    hits = token_index.weighted(docs, index, "abcabca", ("fuzzy",))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "Join Inner" in plan
    # A prefix reaches the scan of the tokens.
    scan = token_index.starting_with(index, "ab")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,ab)" in scan


def test_deletions_of_tokens(spark):
    tokens = spark.createDataFrame([("abcd",), ("aa",), ("x",), (LONG_WORD,)], "token string")
    got = {}
    for row in token_index.deletions_of(tokens).collect():
        got.setdefault(row.token, []).append(row.left)
    assert {t: sorted(x) for t, x in got.items()} == {t: token_index.deletions(t, 2) for t in ("abcd", "aa", "x")}


def test_refreshed_index_equals_a_new_one(spark, docs, index):
    changed = docs.filter("file_id % 4 = 0").select("volume", "file_id").unionByName(
        spark.createDataFrame([("C:", 5001)], "volume string, file_id long")
    )
    fresh = docs.filter("file_id % 8 = 0").withColumn("name", F.lit("brand new_abcc")).withColumn("name_lower", F.lit("brand new_abcc"))
    fresh = fresh.withColumn("tokens", X.tokens(F.col("name")))
    after = docs.join(changed, ["volume", "file_id"], "left_anti").select(docs.columns).unionByName(fresh)
    again = token_index.refreshed(index, changed, fresh)
    anew = token_index.build(after)
    for name in ("tokens", "postings", "name_grams"):
        left, right = (sorted(map(str, getattr(x, name).select(*sorted(anew.__dict__[name].columns)).collect())) for x in (again, anew))
        assert left == right, name
    tiers = list(token_index.TIERS)
    for query in ("brand abcc", "abcc"):
        assert scored(token_index.weighted(after, again, query), tiers) == scored(token_index.weighted(after, anew, query), tiers)


def test_no_documents(docs):
    none = docs.limit(0)
    assert search.search(none, "some words", advanced=True, index=token_index.build(none)).collect() == []
