from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.operators import history, replay, snapshots
from ledgertree.schema import DRAIN_STATE

# 4 forces every busy file through the chunked look-back.
CHUNKS = [4, 4_000_000]


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    facts, log = models.random_log(request.param)
    return (
        facts,
        log,
        spark.createDataFrame(facts, models.FACT_DDL),
        spark.createDataFrame(log, models.LOG_DDL),
    )


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_replay_and_deltas(case, chunk_rows):
    facts, log, facts_df, log_df = case
    state, deltas = models.replay(facts, log)
    got = {tuple(r) for r in replay.replay(facts_df, log_df, chunk_rows=chunk_rows).collect()}
    assert got == state
    fixed = replay.correct_deltas(facts_df, log_df, chunk_rows=chunk_rows)
    assert {r.sequence: r.size_delta for r in fixed.collect()} == deltas


def test_replay_in_slices(case, spark):
    facts, log, facts_df, log_df = case
    cut = len(log) // 3
    cursors = spark.createDataFrame([("V:", cut)], DRAIN_STATE)
    first = replay.replay(facts_df, log_df.filter(F.col("sequence") <= cut))
    second = replay.replay(first, log_df, cursors)
    assert {tuple(r) for r in second.collect()} == models.replay(facts, log)[0]
    assert replay.advance_cursors(log_df, cursors).first().last_sequence == len(log)


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_net_changes(case, spark, chunk_rows):
    _, log, _, log_df = case
    for start, end in ((0, len(log)), (len(log) // 4, len(log) * 3 // 4), (5, 5)):
        window = spark.createDataFrame([("V:", start, end)], "volume string, start_seq long, end_seq long")
        rows = snapshots.net_changes(log_df, window, chunk_rows)
        got = {
            (r.file_id, r.kind, r.name, r.parent_file_id, r.is_directory, r.size_delta, r.old_name, r.old_parent_file_id)
            for r in rows.collect()
        }
        assert got == models.net_changes(log, start, end)


@pytest.mark.parametrize("collapse", [False, True])
@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_merged_history(case, collapse, chunk_rows):
    _, log, _, log_df = case
    rows = log_df.withColumn("item_id", F.col("parent_file_id"))
    merged = history.merge_runs(rows, collapse, chunk_rows)
    got = {
        (r.item_id, r.sequence, r.file_id, r.parent_file_id, r.name, r.kind, r.size_delta) for r in merged.collect()
    }
    want = set()
    for item in (1000, 1001, 1002):
        mine = [(r[0], r[2], r[3], r[4], r[5], r[8]) for r in log if r[3] == item]
        want |= {(item, *row) for row in models.merged_history(mine, collapse)}
    assert got == want


def _diff(spark, rows, start, end):
    at = models.T0
    log = spark.createDataFrame(
        [(s, "C:", f, 1, n, k, False, None, d, at, "Watcher") for s, f, n, k, d in rows], models.LOG_DDL
    )
    window = spark.createDataFrame([("C:", start, end)], "volume string, start_seq long, end_seq long")
    return snapshots.net_changes(log, window).collect()


def test_changes_sum_and_cancel(spark):
    rows = [(1, 1, "new.txt", "Created", 100), (2, 1, "new.txt", "Modified", 50),
            (3, 2, "gone.txt", "Created", 500), (4, 2, "gone.txt", "Deleted", -500)]
    got = _diff(spark, rows, 0, 4)
    assert [(r.file_id, r.kind, r.size_delta, r.name) for r in got] == [(1, "Created", 150, "new.txt")]


def test_rename_across_the_start(spark):
    rows = [(1, 1, "old_name.txt", "Created", 0), (2, 1, "new_name.txt", "Renamed", 0)]
    (row,) = _diff(spark, rows, 1, 2)
    assert (row.kind, row.name, row.old_name) == ("Renamed", "new_name.txt", "old_name.txt")


def test_history_page_both_ways(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "sequence long")

    def page(cursor):
        return [r.sequence for r in history.page(rows, 3, cursor).collect()]

    assert page(None) == [1, 2, 3] and page("f:3") == [4, 5, 6] and page("b:4") == [1, 2, 3] and page("8") == [9, 10]


@pytest.mark.parametrize("collapse", [False, True])
def test_pages_fetched_around_a_cursor(spark, collapse):
    rng = random.Random(3)
    rows, seq = [], 5
    while len(rows) < 260:
        # Runs of up to thirty equal rows, gaps in the numbers, and changes too small to show.
        kind, name, f = rng.choice(models.KINDS), f"n{rng.randint(0, 1)}", rng.randint(1, 2)
        for _ in range(rng.choice([1, 1, 2, 30])):
            seq += rng.randint(1, 4)
            rows.append((seq, "V:", f, 9, name, kind, False, 0, rng.choice([0, 0, 1, 5]), models.T0, "W"))
    log = spark.createDataFrame(rows, models.LOG_DDL).coalesce(1).cache()
    item = history.for_item(log, "V:", 9, True)
    whole = [tuple(r) for r in history.history(item, collapse=collapse).orderBy("sequence").collect()]
    at = 2  # the sequence
    ends = (rows[0][0], rows[-1][0])
    cursors = [None, "f:0", f"f:{seq}", "b:0", f"b:{seq + 9}", str(rows[40][0])]
    cursors += [f"{w}:{rng.randint(0, seq)}" for w in "fb" for _ in range(3)]
    for cursor in cursors:
        got = [tuple(r) for r in history.fetch_page(item, 4, cursor, collapse, ends, 3).collect()]
        way, _, text = (cursor or "f:0").rpartition(":")
        if way == "b":
            want = [r for r in whole if r[at] < int(text)][-4:]
        else:
            want = [r for r in whole if r[at] > int(text)][:4]
        assert got == want, cursor


def test_a_page_reads_rows_in_proportion_to_it(spark):
    rows = [(s, "V:", s % 7, 9, f"n{s % 5}", "Modified", False, 0, 5, models.T0, "W") for s in range(1, 40_001)]
    log = spark.createDataFrame(rows, models.LOG_DDL)
    item = history.for_item(log, "V:", 9, True)
    for cursor in ("f:20000", "b:20000", "f:39990", None):
        part = history.stretch(item, 10, cursor, ends=(1, 40_000), span=8)
        assert part.count() <= 100
        assert history.fetch_page(item, 10, cursor, ends=(1, 40_000), span=8).count() == 10
    assert history.fetch_page(item.limit(0), 10, None).collect() == []


def test_items_with_hot_keys(case, spark):
    _, log, _, log_df = case
    rows = [("V:", 1, False), ("V:", 2, False), ("V:", 1001, True), ("V:", 1002, True), ("W:", 1, False)]
    items = spark.createDataFrame(rows, "volume string, item_id long, is_directory boolean")
    want = sorted((i, r[0]) for _, i, d in rows[:4] for r in log if r[2] == i or (d and r[3] == i))
    for hot_rows in (5, 4_000_000):
        got = history.for_items(log_df, items, hot_rows).select("item_id", "sequence").collect()
        assert sorted(map(tuple, got)) == want
