"""Retention, status and audit jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.functions.display import duration_problem, duration_seconds
from ledgertree.operators import bounds as B
from ledgertree.operators import tree
from ledgertree.schema import LIVE
from ledgertree.session import materialize

# How often pruning is due, and what a skipped run reports.
PRUNE_EVERY = timedelta(hours=24)
SKIPPED_TEXT = "Volume is mid-replay or baseline scanning"


def _ready() -> Column:
    return (F.col("state") == LIVE) & ~F.col("replaying")


def retention_prune(
    log: DataFrame, states: DataFrame, retention: timedelta, now: datetime
) -> tuple[DataFrame, DataFrame]:
    """The log without expired rows of live volumes, and one run row per volume.

    A row without time has not expired, and one without volume belongs to no live
    volume; both stay. The runs say what the prune will have done once its result
    is written; see :func:`prune_runs`.
    """
    cutoff = now - retention
    ready = states.filter(_ready()).select("volume").distinct()
    rows = B.few(ready)
    if rows is None:
        marked = log.join(ready.withColumn("_live", F.lit(True)), "volume", "left")
        live = F.col("_live")
    else:
        marked, live = log, B.listed(rows)
    gone = F.coalesce((F.col("at") < F.lit(cutoff)) & live, F.lit(False))
    kept = marked.filter(~gone).select(*log.columns)
    counts = marked.filter(gone).groupBy("volume").agg(F.count("*").alias("n"))
    return kept, prune_runs(states, counts, cutoff, now)


def prune_runs(
    states: DataFrame, counts: DataFrame, cutoff: datetime, now: datetime, failure: str | None = None
) -> DataFrame:
    """Run rows of a prune that removed ``counts`` (volume, n); with ``failure`` the live volumes' runs failed."""
    stamp = cutoff.strftime("%Y-%m-%dT%H:%M:%S+00:00")
    done = F.concat(F.lit("Deleted "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" rows older than {stamp}"))
    return states.join(counts, "volume", "left").select(
        "volume",
        F.lit(now).alias("run_at"),
        F.when(_ready(), F.lit("SUCCESS" if failure is None else "FAILED")).otherwise(F.lit("SKIPPED")).alias("status"),
        F.when(_ready(), done if failure is None else F.lit(failure)).otherwise(F.lit(SKIPPED_TEXT)).alias("details"),
    )


def prune(
    log: DataFrame, states: DataFrame, retention: timedelta, now: datetime, write: Callable[[DataFrame], object]
) -> DataFrame:
    """Prune and write; the run rows are SUCCESS only if ``write`` returned."""
    kept, runs = retention_prune(log, states, retention, now)
    runs = materialize(runs, "prune-runs")
    try:
        write(kept)
    except PySparkException as error:
        nothing = states.select("volume", F.lit(0).alias("n"))
        return prune_runs(states, nothing, now - retention, now, f"Prune failed: {type(error).__name__}")
    return runs


def prune_due(runs: DataFrame, now: datetime) -> DataFrame:
    last = runs.agg(F.max(F.when(F.col("status") == "SUCCESS", F.col("run_at"))).alias("last_success"))
    return last.withColumn("due", F.coalesce(F.col("last_success") <= F.lit(now - PRUNE_EVERY), F.lit(True)))


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_at"), "volume")


def resolve_retention(snapshots: DataFrame, now: datetime) -> DataFrame:
    """Retention text of each snapshot as seconds and cutoff, and whether it has expired."""
    setting = F.col("retention_setting")
    problem = duration_problem(setting)
    secs = F.when(problem.isNull(), duration_seconds(setting))
    cutoff = F.timestamp_seconds(F.unix_timestamp(F.lit(now)) - secs)
    return snapshots.select(
        "id", "label", "retention_setting", secs.alias("seconds"), problem.alias("problem"),
        cutoff.alias("cutoff"), (F.col("created_at") < cutoff).alias("expired"),
    )


def volume_status(facts: DataFrame, log: DataFrame, cursors: DataFrame, states: DataFrame) -> DataFrame:
    """Figures per volume, and whether all are live."""
    size = facts.groupBy("volume").agg(
        F.count_if("is_directory").alias("directories"),
        F.count_if(~F.col("is_directory")).alias("files"),
        F.sum("size").alias("bytes"),
    )
    ends = log.groupBy("volume").agg(
        F.max("sequence").alias("last_sequence"), F.min("at").alias("oldest_at"), F.max("at").alias("newest_at")
    )
    waiting = B.after_cursor(log, cursors).groupBy("volume").agg(F.count("*").alias("pending"))
    overall = states.agg(F.bool_and(F.col("state") == LIVE).alias("ok")).first()[0]
    # All inputs are one row per volume by now.
    out = states.select("volume", "state")
    for part in (size, ends, waiting, cursors.select("volume", F.col("last_sequence").alias("cursor"))):
        out = out.join(part, "volume", "left")
    zero = F.lit(0)
    return out.select(
        "volume",
        "state",
        F.coalesce("directories", zero).alias("directories"),
        F.coalesce("files", zero).alias("files"),
        F.coalesce("bytes", zero).alias("bytes"),
        F.coalesce("last_sequence", zero).alias("last_sequence"),
        F.coalesce("cursor", zero).alias("cursor"),
        F.coalesce("pending", zero).alias("pending"),
        "oldest_at",
        "newest_at",
        F.lit(LIVE if overall in (True, None) else "BaselineScanning").alias("overall"),
    )


def incomplete_volumes(states: DataFrame) -> DataFrame:
    return states.filter(F.col("state") != LIVE).select("volume", "state")


def with_incomplete(df: DataFrame, states: DataFrame) -> DataFrame:
    """Mark result rows of volumes that are not live."""
    late = incomplete_volumes(states).select("volume")
    rows = B.few(late)
    if rows is not None:
        return df.withColumn("volume_incomplete", B.listed(rows))
    marked = df.join(late.withColumn("volume_incomplete", F.lit(True)), "volume", "left")
    return marked.withColumn("volume_incomplete", F.coalesce("volume_incomplete", F.lit(False)))


def audit(
    facts: DataFrame, parents: DataFrame | None = None, children: DataFrame | None = None
) -> DataFrame:
    """Broken constraints: (check, volume, key, n)."""

    def finding(df: DataFrame, check: str, volume, key, n) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), volume.cast("string").alias("volume"),
            key.cast("string").alias("key"), n.cast("long").alias("n"),
        )

    one = F.lit(1)
    vol = F.col("volume")
    keys = facts.groupBy("volume", "file_id").agg(
        F.count("*").alias("n"), F.max_by(F.struct("parent_file_id", "name", "is_directory"), "parent_file_id").alias("r")
    )
    nodes = keys.select("volume", "file_id", "r.parent_file_id", "r.name", "r.is_directory")
    orphans = (
        facts.filter("parent_file_id <> 0 and parent_file_id <> file_id")
        .select("volume", "file_id", "parent_file_id")
        .join(facts.select("volume", F.col("file_id").alias("parent_file_id")).distinct(), ["volume", "parent_file_id"], "left_anti")
    )
    loops = tree.chains(tree.directories(nodes)).filter("looped")
    rooted = facts.groupBy("volume").agg(
        F.count_if((F.col("parent_file_id") == F.col("file_id")) | (F.col("name") == vol)).alias("roots")
    )
    found = [
        finding(keys.filter("n > 1"), "duplicate_file", vol, F.col("file_id"), F.col("n")),
        finding(orphans, "orphan_parent", vol, F.col("file_id"), one),
        finding(loops, "cycle", vol, F.col("file_id"), one),
        finding(rooted.filter("roots = 0"), "missing_root", vol, vol, one),
        finding(facts.filter("size < 0"), "negative_size", vol, F.col("file_id"), one),
    ]
    if children is not None:
        twice = children.groupBy("parent_id", "volume").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(finding(twice, "duplicate_volume_snapshot", vol, F.col("parent_id"), F.col("n")))
    if parents is not None:
        twice = parents.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(finding(twice, "duplicate_label", F.lit(None), F.col("label"), F.col("n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
