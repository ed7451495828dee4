from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.functions import text as X
from ledgertree.operators import search, token_index, tree


@pytest.fixture(scope="module")
def docs(spark):
    names = ["MyImportantFile.txt", "readme.md", "DRAFT_PROPOSAL.docx", ".profile", "magic file.txt", "notes"]
    rows = [("C:", 1, 1, "C:", True, 0, models.T0, models.T0, 16)] + [
        ("C:", i, 1, n, False, i, models.T0, models.T0, 32 + 2 * (n[0] == ".")) for i, n in enumerate(names, start=2)
    ]
    facts = spark.createDataFrame(rows, models.FACT_DDL)
    return search.build_documents(facts, tree.chains(tree.directories(facts))).cache()


def names(df):
    return {r["name"] for r in df.collect()}


def test_substring(docs):
    for query, count in (("important", 1), ("README", 1), ("draft_proposal", 1), ("imptnt", 0), ("*", 7), ("  ", 7)):
        assert search.search(docs, query).count() == count


def test_documents(docs):
    rows = {r["name"]: r for r in docs.collect()}
    assert rows[".profile"].ext == "" and rows["DRAFT_PROPOSAL.docx"].ext == "docx" and rows["notes"].ext == ""
    assert rows[".profile"].flags == "HA" and rows["C:"].flags == "-" and rows["notes"].attributes == ["archive"]
    assert rows["DRAFT_PROPOSAL.docx"].tokens == ["draft", "proposal", "docx"]


def test_tiers(docs):
    top = search.search(docs, "magic file", advanced=True).first()
    assert top["name"] == "magic file.txt"
    assert names(search.search(docs, "magik", advanced=True)) == {"magic file.txt"}
    # ".profile" shares the gram "pro".
    assert [r["name"] for r in search.search(docs, "propo", advanced=True).collect()] == ["DRAFT_PROPOSAL.docx", ".profile"]


def test_filters(docs):
    assert names(search.search(docs, hidden=True)) == {".profile"}
    assert names(search.search(docs, min_size=3, max_size=4)) == {"readme.md", "DRAFT_PROPOSAL.docx"}
    assert names(search.search(docs, ext=".MD", volume="C:")) == {"readme.md"}
    assert search.search(docs, volume="D:").count() == 0


@pytest.mark.parametrize("word", ["abca", "abcabc", "aabbcc", "ca", "abac"])
def test_within_edits_against_the_definition(spark, word):
    rng = random.Random(word)
    tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(1500)}
    limit = 2 if len(word) > 5 else 1
    df = spark.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    got = {r.t for r in df.filter(X.within_edits(F.col("t"), word, limit)).collect()}
    assert got == {t for t in tokens if models.edit_distance(t, word) <= limit}


def test_reconcile_keeps_rows_without_key(spark):
    hits = spark.createDataFrame([("C:", 1), ("C:", 2), (None, None)], "volume string, file_id long")
    facts = spark.createDataFrame([("C:", 1)], "volume string, file_id long")
    assert {tuple(r) for r in search.reconcile(hits, facts).collect()} == {("C:", 1), (None, None)}


def test_gram_table_finds_what_a_scan_finds(spark, docs, tmp_path):
    path = f"{tmp_path}/grams"
    search.save_gram_table(docs, path)
    grams = spark.read.parquet(path)
    for query in ("important", "E.TXT", "c file", "rop", "me", "imptnt", "*"):
        assert names(search.search_grams(docs, grams, query)) == names(search.search(docs, query, limit=None))
    plan = search.search_grams(docs, grams, "proposal")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_term_stats_follow_added_and_removed_documents(spark, docs):
    ids = sorted(r.uid for r in docs.select("uid").collect())
    first, rest = docs.filter(F.col("uid").isin(ids[:3])), docs.filter(~F.col("uid").isin(ids[:3]))
    merged = search.merge_term_stats(search.term_stats(first), search.term_stats(rest))
    for got, want in zip(merged, search.term_stats(docs), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    back = search.merge_term_stats(merged, search.term_stats(rest), sign=-1)
    assert sorted(map(tuple, back[1].collect())) == sorted(map(tuple, search.term_stats(first)[1].collect()))
    found = search.search(docs, "file", advanced=True, bm25=True, limit=None, stats=merged)
    plain = search.search(docs, "file", advanced=True, bm25=True, limit=None)
    assert {(r.uid, r.score) for r in found.collect()} == {(r.uid, r.score) for r in plain.collect()}


def test_tables_of_one_small_file_are_made_by_many_tasks(docs):
    one = docs.coalesce(1)
    tokens = token_index.tokens_of(token_index.postings_of(one)).coalesce(1)
    made = [search.gram_table(one), token_index.postings_of(one), token_index.grams_of(tokens), token_index.deletions_of(tokens)]
    for df in made:
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
