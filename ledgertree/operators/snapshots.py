"""Snapshots as bookmarks in the log, and the net difference between two."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ledgertree.functions.display import displayable
from ledgertree.operators import blocks as blocks_of
from ledgertree.operators import bounds as B
from ledgertree.operators import tree
from ledgertree.operators.ordered import CHUNK_ROWS, Ordered
from ledgertree.schema import CREATED, DELETED, MODIFIED, PARENT_SNAPSHOTS, RENAMED
from ledgertree.session import materialize

DEFAULT_LIMIT = 20
SCHEMA_VERSION = 2
VERSION = "1.0.0"

_KEYS = ["volume", "file_id"]


class SnapshotError(ValueError):
    """A snapshot cannot be made or found."""


# --- bookmarks ---------------------------------------------------------------------------


def volume_marks(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Per volume: highest sequence and number of facts."""
    ends = log.groupBy("volume").agg(F.max("sequence").alias("sequence_number"))
    sizes = facts.groupBy("volume").agg(F.count("*").alias("facts_count"))
    both = ends.join(sizes, "volume", "full_outer")
    return both.select(
        "volume",
        F.coalesce("sequence_number", F.lit(0)).alias("sequence_number"),
        F.coalesce("facts_count", F.lit(0)).alias("facts_count"),
    )


def create_snapshot(
    log: DataFrame,
    facts: DataFrame,
    parents: DataFrame,
    now: datetime,
    label: str | None = None,
    volumes: list[str] | None = None,
    retention: str = "30d",
    snapshot_id: str | None = None,
    auto: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """New rows for the two snapshot tables.

    Without a label one is made from the time. Empty or taken labels and
    unknown volumes are rejected.
    """
    spark = log.sparkSession
    if label is not None:
        label = label.strip()
        if not label:
            raise SnapshotError("label cannot be empty")
        taken = parents.filter(F.col("label") == label).select("id", "created_at").first()
        if taken:
            raise SnapshotError(f'a snapshot named "{label}" already exists (id {taken.id})')
    else:
        label = now.strftime("auto_%Y-%m-%d_%H-%M-%S" if auto else "snap_%Y%m%d_%H%M%S")
    marks = volume_marks(log, facts)
    if volumes is not None:
        wanted = [v.upper() for v in volumes]
        known = {r.volume for r in marks.filter(F.col("volume").isin(wanted)).select("volume").collect()}
        missing = sorted(set(wanted) - known)
        if missing:
            raise SnapshotError(f"volume {missing[0]} is not registered")
        marks = marks.filter(F.col("volume").isin(wanted))
    sid = snapshot_id or f"parent_{uuid.uuid4().hex}"
    parent = spark.createDataFrame([(sid, label, now, VERSION, SCHEMA_VERSION, retention)], PARENT_SNAPSHOTS)
    children = marks.select(
        F.concat(F.lit(f"snap_{sid}_"), F.col("volume")).alias("id"),
        F.lit(sid).alias("parent_id"),
        "volume",
        "sequence_number",
        "facts_count",
    )
    return parent, children


def auto_snapshot_due(parents: DataFrame, every: timedelta, now: datetime) -> DataFrame:
    """One row: time of the last automatic snapshot and whether another is due."""
    last = parents.agg(F.max(F.when(F.col("label").startswith("auto_"), F.col("created_at"))).alias("last_at"))
    return last.withColumn(
        "due", F.coalesce(F.col("last_at") <= F.lit(now - every), F.lit(True))
    )


def nested(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Snapshots with their volumes nested; a snapshot lists each volume once."""
    rows = children.groupBy(F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("volume", "sequence_number", "facts_count", F.col("id").alias("snapshot")))).alias("volumes")
    )
    empty = F.array().cast(rows.schema["volumes"].dataType)
    return parents.join(rows, "id", "left").withColumn("volumes", F.coalesce("volumes", empty))


def list_snapshots(
    parents: DataFrame, children: DataFrame, volume: str | None = None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Newest first; with ``volume``, only snapshots of it and only its rows."""
    if volume is not None:
        children = children.filter(F.col("volume") == volume.upper())
        parents = parents.join(children.select(F.col("parent_id").alias("id")), "id", "left_semi")
    newest = parents.orderBy(F.desc("created_at"), "id").limit(limit)
    mine = children.join(newest.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return nested(newest, mine).orderBy(F.desc("created_at"), "id")


def get_snapshot(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """By id or label."""
    found = parents.filter((F.col("id") == key) | (F.col("label") == key))
    mine = children.join(found.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return nested(found, mine)


def snapshot_id(parents: DataFrame, key: str) -> str:
    row = parents.filter((F.col("id") == key) | (F.col("label") == key)).select("id").first()
    if row is None:
        raise SnapshotError(f'no snapshot "{key}"')
    return row.id


def delete_snapshot(parents: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the snapshot and its volume rows."""
    sid = snapshot_id(parents, key)
    return parents.filter(F.col("id") != sid), children.filter(F.col("parent_id") != sid)


# --- net difference ------------------------------------------------------------------------


def net_changes(log: DataFrame, bounds: DataFrame | B.Windows, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Net effect per file of the rows inside the windows.

    Read in order, a file's rows fall into lives, each ended by a deletion. A
    life that does not begin with a creation concerns a file that existed before
    the window: from there on every row counts ("settled"). If there is no such
    life, only the last one counts, and only while it has not ended. All of this
    is flags from earlier rows plus aggregates per file; no list of a file's
    rows is ever built.
    """
    bounds = B.windows(bounds)
    inside = B.in_window(log, bounds).withColumn("inside", F.lit(True))
    # The name before a rename that opens the window is in the log before it.
    opens = (
        inside.groupBy(*_KEYS)
        .agg(F.min_by("kind", "sequence").alias("first"))
        .filter(F.col("first") == RENAMED)
        .select(*_KEYS)
    )
    earlier = (
        B.before_window(log, bounds)
        .join(opens, _KEYS, "left_semi")
        .groupBy(*_KEYS)
        .agg(F.max_by(F.struct("parent_file_id", "name"), "sequence").alias("r"), F.max("sequence").alias("sequence"))
        .select(*_KEYS, "sequence", "r.parent_file_id", "r.name")
    )
    columns = [*_KEYS, "sequence", "parent_file_id", "name", "kind", "is_directory", "size_delta", "inside"]
    rows = inside.select(*columns).unionByName(earlier, allowMissingColumns=True)

    kind = F.col("kind")
    counts = F.col("inside").isNotNull()
    seen = Ordered(rows, _KEYS, "sequence", chunk_rows, counted=inside).look_back(
        last={"prev_kind": F.when(counts, kind), "prev": F.struct("name", "parent_file_id")},
        total={"spent": F.when(counts & (kind != RENAMED), F.col("size_delta")).otherwise(F.lit(0))},
    )
    begins = F.col("prev_kind").isNull() | (F.col("prev_kind") == DELETED)
    lives = seen.then(
        lambda df: df.filter(counts)
        .withColumn("begins", begins)
        .withColumn("settles", F.col("begins") & (kind != CREATED))
    )
    rows = lives.look_back(
        last={
            "was_settled": F.when(F.col("settles"), F.lit(True)),
            "turn_before": F.when(kind.isin(DELETED, RENAMED), kind),
        }
    ).df
    seq = F.col("sequence")
    settled = F.coalesce("was_settled", F.lit(False)) | F.col("settles")
    first_settled = F.col("settles") & F.col("was_settled").isNull()
    fresh_rename = settled & (kind == RENAMED) & F.coalesce(F.col("turn_before") != RENAMED, F.lit(True))
    place = F.struct("name", "parent_file_id")

    def last_where(value, condition):
        return F.max_by(value, F.when(condition, seq))

    per_file = rows.groupBy(*_KEYS).agg(
        F.max(settled).alias("settled"),
        F.max_by("kind", "sequence").alias("end_kind"),
        F.max(F.when(settled & kind.isin(DELETED, RENAMED), F.struct("sequence", "kind"))).alias("turn"),
        F.max(F.when(settled & (kind == CREATED), seq)).alias("last_created"),
        last_where(place, kind.isin(CREATED, RENAMED) | first_settled).alias("place"),
        last_where(F.col("is_directory"), first_settled).alias("settled_dir"),
        last_where(F.col("is_directory"), F.col("begins")).alias("begun_dir"),
        F.sum(F.when(settled & ((kind != RENAMED) | first_settled), F.col("size_delta"))).alias("settled_delta"),
        F.sum(F.when(kind != RENAMED, F.col("size_delta"))).alias("all_delta"),
        last_where(F.col("spent") + F.col("size_delta"), kind == DELETED).alias("closed_delta"),
        last_where(F.coalesce("prev", place), fresh_rename).alias("old"),
    )
    turn = F.col("turn.kind")
    net_kind = (
        F.when(~F.col("settled"), F.when(F.col("end_kind") != DELETED, F.lit(CREATED)))
        .when(turn.isNull(), F.lit(MODIFIED))
        .when(turn == RENAMED, F.lit(RENAMED))
        .when(F.col("last_created") > F.col("turn.sequence"), F.lit(MODIFIED))
        .otherwise(F.lit(DELETED))
    )
    delta = F.when(F.col("settled"), F.coalesce("settled_delta", F.lit(0))).otherwise(
        F.col("all_delta") - F.coalesce("closed_delta", F.lit(0))
    )
    return per_file.select(
        *_KEYS,
        "place.parent_file_id",
        "place.name",
        F.when(F.col("settled"), F.col("settled_dir")).otherwise(F.col("begun_dir")).alias("is_directory"),
        delta.cast("long").alias("size_delta"),
        net_kind.alias("kind"),
        F.col("old.name").alias("old_name"),
        F.col("old.parent_file_id").alias("old_parent_file_id"),
    ).filter("kind is not null")


def diff(
    log: DataFrame,
    facts: DataFrame,
    bounds: DataFrame | B.Windows,
    path_prefix: str | None = None,
    chain: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    stats: DataFrame | None = None,
    blocks: blocks_of.Blocks | None = None,
) -> DataFrame:
    """Displayed net changes with ``path``, optionally below a path prefix.

    With ``blocks``, made from this log, the changes come from summaries and the rows
    where the windows begin and end; otherwise from all rows of the windows. ``stats``
    saves looking for the oldest row kept. A prefix that names a volume leaves out the others.
    Order the result by path, volume and file_id for a report.
    """
    bounds = B.windows(bounds)
    if path_prefix is not None and path_prefix[1:2] == ":":
        bounds = bounds.for_volume(path_prefix[:2].upper())
    B.check_window(log, bounds, stats)
    if blocks is None:
        changes = net_changes(log, bounds, chunk_rows)
    else:
        changes = blocks_of.net_changes(log, blocks, bounds)
    changes = changes.filter(displayable(F.col("kind"), F.col("size_delta")))
    return diff_paths(changes, facts, log, path_prefix, chain)


def diff_paths(
    changes: DataFrame,
    facts: DataFrame,
    log: DataFrame,
    path_prefix: str | None = None,
    chain: DataFrame | None = None,
) -> DataFrame:
    """Add ``volume/folders/name``; folders from facts, else as the log last had them.

    ``chain`` saves computing the folder chains of ``facts``.
    """
    changes = materialize(changes, "changes")
    folders = changes.select("volume", F.col("parent_file_id").alias("file_id"))
    chain = tree.known_chains(folders, facts, log, chain)
    dirs = tree.directory_paths(chain).withColumnRenamed("file_id", "parent_file_id")
    placed = changes.join(dirs, ["volume", "parent_file_id"], "left")
    parts = F.filter(F.array(F.col("volume"), F.coalesce("dir_path", F.lit("")), F.col("name")), lambda s: s != "")
    out = placed.select(*changes.columns, F.array_join(parts, "/").alias("path"))
    if path_prefix is not None:
        out = out.filter(F.lower("path").startswith(path_prefix.replace("\\", "/").lower()))
    return out


def snapshot_diff(
    log: DataFrame,
    facts: DataFrame,
    parents: DataFrame,
    children: DataFrame,
    a: str,
    b: str,
    volume: str | None = None,
    path_prefix: str | None = None,
    limit: int | None = None,
    chain: DataFrame | None = None,
    stats: DataFrame | None = None,
    blocks: blocks_of.Blocks | None = None,
) -> DataFrame:
    """Difference of two snapshots by id or label, ordered by path."""
    bounds = B.windows(B.bounds_between(children, snapshot_id(parents, a), snapshot_id(parents, b)))
    if volume is not None:
        bounds = bounds.for_volume(volume.upper())
    if bounds.rows == []:
        raise SnapshotError("the snapshots have no volume in common")
    out = diff(log, facts, bounds, path_prefix, chain, stats=stats, blocks=blocks).orderBy("path", "volume", "file_id")
    return out if limit is None else out.limit(limit)
