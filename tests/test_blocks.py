"""Net changes from summaries of blocks, against the row-by-row model."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.operators import blocks, bounds, snapshots

WINDOW = "volume string, start_seq long, end_seq long"
VOLUMES = 40


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """One log for each of many volumes, so that one job tests as many windows."""
    rows = {}
    for k in range(VOLUMES):
        _, log = models.random_log(100 + k, files=12, most=25)
        rows[f"V{k}"] = [(r[0], f"V{k}", *r[2:]) for r in log]
    df = spark.createDataFrame([r for log in rows.values() for r in log], models.LOG_DDL)
    path = str(tmp_path_factory.mktemp("log") / "log")
    blocks.with_previous(df).repartitionByRange(8, "volume", "sequence").sortWithinPartitions("volume", "sequence").write.parquet(path)
    return rows, spark.read.parquet(path)


def windows_of(spark, rows, seed):
    r = random.Random(seed)
    out = []
    for volume, log in rows.items():
        start, end = sorted(r.sample(range(len(log) + 1), 2))
        out.append((volume, start, end) if r.random() < 0.9 else (volume, 0, len(log)))
    return out, spark.createDataFrame(out, WINDOW)


def changes_of(rows):
    names = ("volume", "file_id", "kind", "name", "parent_file_id", "is_directory", "size_delta", "old_name", "old_parent_file_id")
    return {tuple(r[c] for c in names) for r in rows.collect()}


def expected(rows, windows):
    return {(v, *x) for v, start, end in windows for x in models.net_changes(rows[v], start, end)}


@pytest.mark.parametrize("block, fan, levels", [(5, 2, 4), (16, 3, 2), (1, 2, 3), (1000, 4, 1)])
def test_any_window_from_blocks(spark, logs, block, fan, levels):
    rows, log = logs
    table = blocks.build(log, bounds.log_stats(log), None, block, fan, levels)
    for seed in (1, 2):
        windows, df = windows_of(spark, rows, seed)
        assert changes_of(blocks.net_changes(log, table, df)) == expected(rows, windows)


def test_more_volumes_than_literals(spark, logs, monkeypatch):
    rows, log = logs
    monkeypatch.setattr(bounds, "LITERAL_VOLUMES", 3)
    table = blocks.build(log, bounds.log_stats(log), None, 6, 3, 2)
    windows, df = windows_of(spark, rows, 3)
    assert changes_of(blocks.net_changes(log, table, df)) == expected(rows, windows)


def test_plain_net_changes_agree_where_sizes_are_missing(spark, logs):
    _, log = logs
    some = log.withColumn("size_delta", F.when(F.col("sequence") % 3 > 0, F.col("size_delta")))
    whole = bounds.log_stats(log).selectExpr("volume", "0 as start_seq", "max_sequence as end_seq")
    table = blocks.build(some, bounds.log_stats(some), None, 5, 2, 3)
    got = changes_of(blocks.net_changes(some, table, whole))
    assert got == changes_of(snapshots.net_changes(some.fillna(0, ["size_delta"]), whole))


def test_combining_is_associative(spark, logs):
    _, log = logs
    r = random.Random(5)
    single = blocks.row_summaries(log)
    whole = sorted(map(str, blocks.combine(single).collect()))
    for _ in range(2):
        cuts = sorted(r.sample(range(1, 200), 12))
        block = sum((F.when(F.col("first_seq") > c, 1).otherwise(0) for c in cuts), F.lit(0))
        parts = blocks.combine(single.withColumn("block", block), ["volume", "file_id", "block"])
        pairs = blocks.combine(parts.withColumn("block", F.floor(F.col("block") / 3)), ["volume", "file_id", "block"])
        for again in (parts, pairs):
            assert sorted(map(str, blocks.combine(again.drop("block")).select("volume", "file_id", *blocks.FIELDS).collect())) == whole


def test_blocks_and_places_in_batches(spark, logs):
    rows, log = logs
    plain = log.drop("previous")
    once = blocks.build(log, bounds.log_stats(log), None, 5, 2, 3)
    table, last, parts = None, None, None
    for low, high in ((0, 31), (31, 33), (33, 10_000)):
        batch = plain.filter((F.col("sequence") > low) & (F.col("sequence") <= high))
        more = blocks.with_previous(batch, last)
        parts = more if parts is None else parts.unionByName(more)
        last = blocks.last_places(batch, last)
        table = blocks.build(parts, bounds.log_stats(parts), table, 5, 2, 3)
    assert sorted(map(str, parts.select("volume", "sequence", "previous").collect())) == sorted(
        map(str, log.select("volume", "sequence", "previous").collect())
    )
    columns = ["volume", "level", "block", "file_id", *blocks.FIELDS]
    assert sorted(map(str, table.table.select(columns).collect())) == sorted(map(str, once.table.select(columns).collect()))
    assert sorted(map(str, table.ends.collect())) == sorted(map(str, once.ends.collect()))


def test_all_levels_come_from_one_move_of_the_log(spark, logs, monkeypatch):
    _, log = logs
    stats, written = bounds.log_stats(log), []

    def recorded(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    materialize = blocks.materialize
    monkeypatch.setattr(blocks, "materialize", recorded)
    once = blocks.build(log, stats, None, 4, 2, 3).table
    plans = [plan for name, plan in written if name == "blocks"]
    assert len(plans) == 1 and plans[0].count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plans[0]
    # Blocks too long for one task are made from those below them.
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 8)
    steps = blocks.build(log, stats, None, 4, 2, 3).table
    assert sorted(map(str, once.collect())) == sorted(map(str, steps.collect()))


def test_a_window_reads_few_rows_and_none_before_it(spark, logs):
    rows, log = logs
    table = blocks.build(log, bounds.log_stats(log), None, 8, 2, 4)
    length = len(rows["V0"])
    window = spark.createDataFrame([("V0", 20, length - 3)], WINDOW)
    found = blocks.window_summaries(log, table, window)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(sequence,20)" in plan and "EqualTo(volume,V0)" in plan
    # Rows before the window may be gone, and those that blocks hold are not read either.
    ends = log.filter("sequence > 20 and (sequence < 24 or sequence >= {})".format((length - 2) // 8 * 8))
    part = table.table.filter("(block + 1) * 8 * pow(2, level) > 20")
    fewer = blocks.Blocks(part, table.ends, 8, 2, 4)
    assert changes_of(blocks.net_changes(ends, fewer, window)) == expected(rows, [("V0", 20, length - 3)])
    per_file = found.groupBy("file_id").count().agg(F.max("count")).first()[0]
    assert per_file <= 2 * 8 + 2 * 4


def test_empty_log_and_windows(spark, logs):
    _, log = logs
    none = log.limit(0)
    table = blocks.build(none, bounds.log_stats(none), None, 4, 2, 2)
    assert blocks.net_changes(none, table, spark.createDataFrame([("V0", 0, 9)], WINDOW)).collect() == []
    assert blocks.net_changes(log, table, spark.createDataFrame([], WINDOW)).collect() == []
