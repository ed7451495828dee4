"""Interval labels against ancestor chains, on random trees with rings, orphans and several roots."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.operators import intervals, tree

NODE_DDL = "volume string, file_id long, parent_file_id long, name string, is_directory boolean, size long"


def random_tree(seed, folders=120, files=200):
    r = random.Random(seed)
    rows = []
    for volume in ("C:", "D:"):
        for n in range(1, folders):
            kind = r.random()
            parent = n if kind < 0.03 or n == 1 else 9_000 + n if kind < 0.06 else r.randint(max(1, n - 12), n)
            if kind > 0.97:
                parent = min(n + r.randint(1, 4), folders - 1)  # may close a ring
            if n in (30, 31):  # does close one
                parent = 61 - n
            rows.append((volume, n, parent, volume if n == 1 else f"d{n}", True, 0))
        for n in range(files):
            rows.append((volume, 10_000 + n, r.randint(1, folders + 3), f"f{n}", False, r.randint(0, 99)))
    return rows


def facts_of(spark, rows):
    df = spark.createDataFrame(rows, NODE_DDL)
    return df.withColumns({"created_at": F.lit(models.T0), "modified_at": F.lit(models.T0), "attributes": F.lit(0)})


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request, tmp_path_factory):
    facts = facts_of(spark, random_tree(request.param))
    chain = tree.chains(tree.directories(facts))
    path = str(tmp_path_factory.mktemp("labelled") / "facts")
    numbers = intervals.labels(chain)
    intervals.labelled(facts, numbers).repartitionByRange(4, "volume", "at").sortWithinPartitions("volume", "at").write.parquet(path)
    return facts, chain, numbers, spark.read.parquet(path)


def test_ranges_are_subtrees(case):
    _, chain, numbers, _ = case
    ups = {(r.volume, r.file_id): [a.id for a in r.visited] for r in chain.filter("not looped").collect()}
    assert chain.filter("looped").count() > 0
    span = {(r.volume, r.file_id): (r.enter, r.leave) for r in numbers.collect()}
    assert set(span) == set(ups)
    for volume in ("C:", "D:"):
        mine = sorted(v[0] for k, v in span.items() if k[0] == volume)
        assert mine == list(range(len(mine)))
    for (volume, n), visited in ups.items():
        above = {m for (v, m), (enter, leave) in span.items() if v == volume and enter <= span[volume, n][0] < leave}
        assert above == set(visited)


def test_hot_parents_get_the_same_numbers(case):
    _, chain, numbers, _ = case
    assert sorted(map(tuple, intervals.labels(chain, chunk_rows=5).collect())) == sorted(map(tuple, numbers.collect()))


def test_rows_below_any_folder(case):
    facts, chain, numbers, stored = case
    ringed = chain.filter("looped and volume = 'C:'").first().file_id
    for root in (1, 2, 5, 40, ringed, 9_999):
        want = sorted(r.file_id for r in tree.subtree(facts, chain, "C:", root).collect())
        assert sorted(r.file_id for r in intervals.subtree(stored, numbers, chain, "C:", root).collect()) == want
    assert intervals.folders_below(numbers, "C:", ringed) is None
    below = {r.file_id for r in intervals.folders_below(numbers, "C:", 1).collect()}
    assert below == {r.file_id for r in chain.filter("volume = 'C:' and file_id <> 1 and array_contains(visited.id, 1)").collect()}


def test_a_subtree_is_a_pushed_range(spark, case):
    _, chain, numbers, stored = case
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = intervals.subtree(stored, numbers, chain, "C:", 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at," in plan and "LessThan(at," in plan and "Join" not in plan


@pytest.mark.parametrize("chunk_rows", [7, 4_000_000])
def test_rollup_by_running_sums(case, chunk_rows):
    facts, chain, numbers, _ = case
    want = sorted(map(tuple, tree.rollup_sizes(facts, chain).select("volume", "file_id", "name", "size", "item_count").collect()))
    assert sorted(map(tuple, intervals.rollup_sizes(facts, numbers, chain, chunk_rows).collect())) == want


def test_only_touched_volumes_are_numbered_anew(spark, case):
    facts, _, numbers, _ = case
    moved = spark.createDataFrame([("D:", 40, 2), ("D:", 60, 1)], "volume string, file_id long, to long")
    after = facts.join(moved, ["volume", "file_id"], "left").withColumn("parent_file_id", F.coalesce("to", "parent_file_id")).drop("to")
    chain = tree.chains(tree.directories(after))
    got = intervals.relabelled(numbers, chain, moved)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intervals.labels(chain).collect()))
    empty = tree.chains(tree.directories(facts.limit(0)))
    assert intervals.labels(empty).collect() == []
