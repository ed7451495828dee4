"""The maintained rollup equals the one made anew, after any batches."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.operators import replay, rollup, tree
from ledgertree.session import materialize


def start(r, volume):
    rows = [(volume, 1, 1, volume, True, 0)]
    rows += [(volume, n, r.randint(1, n - 1), f"d{n}", True, 0) for n in range(2, 40) if n % 9]
    rows += [(volume, 100 + n, r.randint(1, 41), f"f{n}", False, r.randint(0, 50)) for n in range(80)]
    return [(*x, models.T0, models.T0, 16 if x[4] else 32) for x in rows]


def batch(r, seq, rows, folders):
    """Mostly files; folders move anywhere, also below themselves, go, come back and change their kind."""
    out = []
    for _ in range(rows):
        seq += 1
        n = r.randint(2, 42) if r.random() < folders else r.randint(100, 190)
        is_dir = (n < 100) ^ (r.random() < 0.03)
        kind = r.choice(models.KINDS)
        out.append((seq, r.choice(["C:", "D:"]), n, r.randint(1, 42), f"n{r.randint(0, 3)}", kind, is_dir, r.randint(-1, 50), 0, models.T0, "W"))
    return out


def table(df):
    return sorted(map(tuple, df.select("volume", "file_id", "name", *rollup.SUMS, *rollup.OWN).collect()))


def visited(chain):
    return {(r.volume, r.file_id): (tuple(a.id for a in r.visited), r.looped) for r in chain.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_batches(spark, seed):
    r = random.Random(seed)
    facts = spark.createDataFrame(start(r, "C:") + start(r, "D:"), models.FACT_DDL)
    chain = tree.chains(tree.directories(facts))
    stored = materialize(rollup.build(facts, chain), "stored")
    seq = 0
    for rows, folders in ((30, 0.0), (12, 1.0), (40, 0.3)):
        log_rows = batch(r, seq, rows, folders)
        seq += rows
        log = spark.createDataFrame(log_rows, models.LOG_DDL)
        after = materialize(replay.replay(facts, log), "after")
        change, chain_after = rollup.changes(stored, facts, after, log, chain)
        stored = materialize(rollup.applied(stored, change), "stored")
        anew = tree.chains(tree.directories(after))
        assert visited(chain_after) == visited(anew)
        assert table(stored) == table(rollup.build(after, anew))
        facts, chain = after, chain_after


def test_a_small_batch_touches_few_rows(spark):
    r = random.Random(9)
    rows = [("C:", 1, 1, "C:", True, 0)] + [("C:", n, n // 2, f"d{n}", True, 0) for n in range(2, 2000)]
    rows += [("C:", 10_000 + n, r.randint(1, 1999), f"f{n}", False, 5) for n in range(4000)]
    facts = spark.createDataFrame([(*x, models.T0, models.T0, 32) for x in rows], models.FACT_DDL)
    chain = tree.chains(tree.directories(facts))
    stored = rollup.build(facts, chain)
    log = spark.createDataFrame(
        [(1, "C:", 10_000, 7, "f", "Modified", False, 9, 0, models.T0, "W"), (2, "C:", 1500, 3, "d1500", "Renamed", True, 0, 0, models.T0, "W")],
        models.LOG_DDL,
    )
    change, after = rollup.changes(stored, facts, replay.replay(facts, log), log, chain)
    # Two folders of a file and two places of a folder, each at most eleven deep.
    assert change.sums.count() <= 4 * 11
    assert after.count() == chain.count()


def test_nothing_happens(spark):
    facts = spark.createDataFrame(start(random.Random(1), "C:"), models.FACT_DDL)
    chain = tree.chains(tree.directories(facts))
    stored = rollup.build(facts, chain)
    change, _ = rollup.changes(stored, facts, facts, facts.limit(0), chain)
    assert change.sums.count() == 0 and table(rollup.applied(stored, change)) == table(stored)
    empty = facts.limit(0)
    assert table(rollup.build(empty, tree.chains(tree.directories(empty)))) == []
