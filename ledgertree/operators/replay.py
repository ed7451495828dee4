"""Folding the change log into current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertree.operators import bounds as B
from ledgertree.operators.ordered import CHUNK_ROWS, Ordered
from ledgertree.schema import CREATED, DELETED, MODIFIED
from ledgertree.sources.listing import baseline_merge

_BASELINE = "Baseline"
_KEYS = ["volume", "file_id"]


def _timeline(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows preceded, per file, by its current fact as a row at sequence -1.

    With the fact inside the timeline, one shuffle of both inputs serves every
    look-back and every aggregate; there is no separate join.
    """
    observed = F.coalesce(
        *([F.col("observed_size")] if "observed_size" in log.columns else []),
        *([F.col("size_delta")] if "size_delta" in log.columns else []),
        F.lit(0),
    )
    attributes = F.col("attributes") if "attributes" in log.columns else F.lit(0)
    seen = F.when(F.col("is_directory") | (F.col("kind") == DELETED), F.lit(0)).otherwise(
        F.greatest(observed, F.lit(0))
    )
    changes = log.select(
        *_KEYS, "sequence", "kind", "parent_file_id", "name", "is_directory",
        seen.cast("long").alias("size"),
        F.col("at").alias("created_at"), F.col("at").alias("modified_at"),
        attributes.cast("int").alias("attributes"),
        (F.col("size_delta") if "size_delta" in log.columns else F.lit(0)).cast("long").alias("size_delta"),
        (F.col("source") if "source" in log.columns else F.lit(None).cast("string")).alias("source"),
    )
    base = facts.select(
        *_KEYS, F.lit(-1).cast("long").alias("sequence"), F.lit(_BASELINE).alias("kind"),
        "parent_file_id", "name", "is_directory", "size", "created_at", "modified_at", "attributes",
        F.lit(0).cast("long").alias("size_delta"), F.lit(None).cast("string").alias("source"),
    )
    return base.unionByName(changes)


def _with_previous(facts: DataFrame, log: DataFrame, chunk_rows: int) -> DataFrame:
    rows = Ordered(_timeline(facts, log), _KEYS, "sequence", chunk_rows, counted=log)
    content = F.col("kind").isin(_BASELINE, CREATED, MODIFIED, DELETED)
    was = F.when(content, F.struct("size", (F.col("kind") != DELETED).alias("alive")))
    return rows.look_back(last={"was": was}).df


def correct_deltas(facts: DataFrame, log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rewrite each row's ``size_delta`` as observed size minus previous size.

    Directories get 0, deletions minus the previous size, renames stay as they
    are. Without an observation the size is the recorded change, at least 0.
    """
    rows = _with_previous(facts, log, chunk_rows).filter(F.col("kind") != _BASELINE)
    before = F.coalesce("was.size", F.lit(0))
    delta = (
        F.when(F.col("is_directory") & F.col("kind").isin(CREATED, MODIFIED, DELETED), F.lit(0))
        .when(F.col("kind") == DELETED, -before)
        .when(F.col("kind").isin(CREATED, MODIFIED), F.col("size") - before)
        .otherwise(F.col("size_delta"))
    )
    return rows.select(
        "sequence", *_KEYS, "parent_file_id", "name", "kind", "is_directory",
        delta.cast("long").alias("size_delta"), F.col("modified_at").alias("at"), "source",
        F.col("size").alias("observed_size"), "attributes",
    )


def replay(
    facts: DataFrame, log: DataFrame, cursors: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Facts after the log.

    Creations and modifications upsert a file, keeping ``created_at`` while it
    exists; renames move it only if it exists; deletions remove that row alone.
    Per file this reduces to: the last content row decides existence, size and
    times; the last row of all decides name and parent; the last row that
    brought it into being decides ``created_at``.
    """
    if cursors is not None:
        log = B.after_cursor(log, cursors)
    rows = _with_previous(facts, log, chunk_rows)
    kind = F.col("kind")
    stores = kind.isin(_BASELINE, CREATED, MODIFIED)
    content = stores | (kind == DELETED)
    born = stores & ~F.coalesce("was.alive", F.lit(False))
    state = rows.groupBy(*_KEYS).agg(
        F.max_by(F.struct("parent_file_id", "name"), "sequence").alias("place"),
        F.max_by(
            F.struct("kind", "is_directory", "size", "modified_at", "attributes"),
            F.when(content, F.col("sequence")),
        ).alias("body"),
        F.max_by("created_at", F.when(born, F.col("sequence"))).alias("created_at"),
    )
    return state.filter(F.col("body").isNotNull() & (F.col("body.kind") != DELETED)).select(
        *_KEYS, "place.parent_file_id", "place.name", "body.is_directory", "body.size",
        "created_at", "body.modified_at", "body.attributes",
    )


def advance_cursors(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per-volume position after the rows a replay consumed."""
    done = (
        B.after_cursor(log, cursors).groupBy("volume").agg(F.max("sequence").alias("last_sequence"))
    )
    both = cursors.select("volume", "last_sequence").unionByName(done)
    return both.groupBy("volume").agg(F.max("last_sequence").alias("last_sequence"))


def reconcile(facts: DataFrame, scan: DataFrame, log: DataFrame, start: DataFrame) -> DataFrame:
    """A scan that overlapped live changes: merge it, then replay the log since it began."""
    return replay(baseline_merge(facts, scan, purge=True), log, start)
