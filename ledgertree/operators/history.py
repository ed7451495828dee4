"""Merged change history of files and folders."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ledgertree.functions.display import displayable, human_delta, relative_age
from ledgertree.functions.text import ascii_lower
from ledgertree.operators import bounds as B, tree
from ledgertree.operators.ordered import CHUNK_ROWS, Ordered, join_unique
from ledgertree.schema import MODIFIED, RENAMED

DEFAULT_LIMIT = 100
#: Sequences on each side of a cursor that a page looks at first.
SPAN = 1 << 14
_ITEM = ["volume", "item_id"]


def for_item(log: DataFrame, volume: str, file_id: int, is_directory: bool) -> DataFrame:
    """Log rows of one file, or of one folder and its direct children.

    The ids are literals, so the predicate reaches the scan.
    """
    mine = F.col("file_id") == file_id
    if is_directory:
        mine = mine | (F.col("parent_file_id") == file_id)
    return log.filter((F.col("volume") == volume) & mine).withColumn("item_id", F.lit(file_id).cast("long"))


def for_items(log: DataFrame, items: DataFrame, hot_rows: int = CHUNK_ROWS) -> DataFrame:
    """The same for a table of items: volume, item_id, is_directory.

    A row of a child appears under its own item and under its folder's.
    """
    own = join_unique(
        log.withColumn("item_id", F.col("file_id")),
        items.select("volume", "item_id"),
        ["volume", "item_id"],
        "left_semi",
        hot_rows,
    )
    below = join_unique(
        log.filter("file_id <> parent_file_id").withColumn("item_id", F.col("parent_file_id")),
        items.filter("is_directory").select("volume", "item_id"),
        ["volume", "item_id"],
        "left_semi",
        hot_rows,
    )
    return own.unionByName(below)


def for_path(log: DataFrame, facts: DataFrame, path: str) -> DataFrame:
    """Log rows of the file or folder at a path, also a deleted one."""
    volume, file_id = tree.resolve_path(path, facts, log)
    return for_item(log, volume, file_id, is_directory(facts, log, volume, file_id))


def item_keys(log: DataFrame) -> DataFrame:
    """Item keys of all log rows, to find hot ones in without the joins above."""
    own = log.select("volume", F.col("file_id").alias("item_id"))
    return own.unionByName(log.select("volume", F.col("parent_file_id").alias("item_id")))


def is_directory(facts: DataFrame, log: DataFrame, volume: str, file_id: int) -> bool:
    """Whether an id is a folder: as facts say, else as the log says."""
    at = (F.col("volume") == volume) & (F.col("file_id") == file_id)
    row = facts.filter(at).select("is_directory").first()
    if row and row[0]:
        return True
    row = log.filter(at).select("is_directory").first()
    return bool(row and row[0])


def in_range(
    rows: DataFrame, since: datetime | None = None, until: datetime | None = None, kind: str | None = None
) -> DataFrame:
    """Both ends inclusive; kind in any letter case."""
    if since is not None:
        rows = rows.filter(F.col("at") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("at") <= F.lit(until))
    if kind is not None:
        rows = rows.filter(ascii_lower(F.col("kind")) == kind.lower())
    return rows


def merge_runs(
    rows: DataFrame, collapse: bool = False, chunk_rows: int = CHUNK_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Merge consecutive rows of an item that show the same thing.

    Consecutive rows of one file with the same kind and name become one row with
    their changes summed and everything else from the last. Modifications stay
    separate unless ``collapse``, which also lets names differ. Rows of other
    children in between break a run. A row that starts a run lends its sequence
    as run number, so runs group without a running count.
    """
    ordered = Ordered(rows, _ITEM, "sequence", chunk_rows, counted)
    seen = ordered.look_back(last={"prev": F.struct("kind", "file_id", "name")})
    same = (F.col("prev.kind") == F.col("kind")) & (F.col("prev.file_id") == F.col("file_id"))
    if not collapse:
        same = same & (F.col("prev.name") == F.col("name")) & (F.col("kind") != MODIFIED)
    starts = F.when(~F.coalesce(same, F.lit(False)), F.col("sequence"))
    runs = seen.then(lambda df: df.withColumn("start", starts)).look_back(last={"open": F.col("start")}).df
    return (
        runs.withColumn("run", F.coalesce("start", "open"))
        .groupBy(*_ITEM, "run", "kind", "file_id")
        .agg(
            F.max_by(
                F.struct("parent_file_id", "name", "at", "source"), "sequence"
            ).alias("l"),
            F.max_by("is_directory", F.when(F.col("sequence") == F.col("run"), F.lit(1))).alias("is_directory"),
            F.max("sequence").alias("sequence"),
            F.sum("size_delta").alias("size_delta"),
        )
        .select(*_ITEM, "sequence", "file_id", "l.parent_file_id", "l.name", "kind", "is_directory",
                "size_delta", "l.at", "l.source")
    )


def shown(rows: DataFrame) -> DataFrame:
    return rows.filter(displayable(F.col("kind"), F.col("size_delta")))


def history(
    rows: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    kind: str | None = None,
    collapse: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Displayed history of the item rows from :func:`for_item` or :func:`for_items`."""
    return shown(merge_runs(in_range(rows, since, until, kind), collapse, chunk_rows, counted))


def page(rows: DataFrame, limit: int = DEFAULT_LIMIT, cursor: str | None = None) -> DataFrame:
    """A page of merged rows: "f:<sequence>" goes forward, "b:<sequence>" backward."""
    if cursor is None:
        return rows.orderBy("sequence").limit(limit)
    way, _, text = cursor.rpartition(":")
    position = int(text)
    if way == "b":
        last = rows.filter(F.col("sequence") < position).orderBy(F.desc("sequence")).limit(limit)
        return last.orderBy("sequence")
    return rows.filter(F.col("sequence") > position).orderBy("sequence").limit(limit)


def stretch(
    rows: DataFrame,
    limit: int = DEFAULT_LIMIT,
    cursor: str | None = None,
    collapse: bool = False,
    ends: tuple[int, int] | None = None,
    span: int = SPAN,
) -> DataFrame:
    """The rows of one item around a cursor that its page needs, see :func:`fetch_page`."""
    if ends is None:
        found = rows.agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).first()
        ends = (found.low, found.high)
    oldest, newest = ends
    if oldest is None:
        return rows
    way, _, text = (cursor or f"f:{oldest - 1}").rpartition(":")
    position = min(max(int(text), oldest - 1), newest + 1)
    backward = way == "b"
    low, high = position - span, position + span
    while True:
        part = rows.filter((F.col("sequence") >= low) & (F.col("sequence") <= high))
        seen = displayable(F.col("kind"), F.col("size_delta"))
        wanted = F.col("sequence") < position if backward else F.col("sequence") > position
        # The run at the far end of the stretch may go on beyond it.
        far = F.min_by if backward else F.max_by
        state = merge_runs(part, collapse).agg(
            F.count_if(seen & wanted).alias("n"),
            F.coalesce(far(seen & wanted, "sequence"), F.lit(False)).alias("open"),
            (F.count_if(~wanted) > 0).alias("closed"),
        ).first()
        far_end = low <= oldest if backward else high >= newest
        near_end = high >= newest if backward else low <= oldest
        # A run on the other side of the cursor shows that the first on this side is whole.
        near = state.closed or near_end
        enough = far_end or state.n - state.open >= limit
        if near and enough:
            return part
        span *= 2
        if backward:
            low, high = (low if enough else position - span), (high if near else position + span)
        else:
            low, high = (low if near else position - span), (high if enough else position + span)


def fetch_page(
    rows: DataFrame,
    limit: int = DEFAULT_LIMIT,
    cursor: str | None = None,
    collapse: bool = False,
    ends: tuple[int, int] | None = None,
    span: int = SPAN,
) -> DataFrame:
    """The page of one item's displayed history at a cursor, from the rows around it.

    What ``page(history(rows), limit, cursor)`` gives, without merging the item's whole
    history: a stretch of sequences around the cursor is read and doubled until it holds the
    page in whole runs. Ranges of sequences reach the scan, and a log is stored by them.
    ``ends`` are the oldest and newest sequence of the log, where they are kept.
    """
    return page(shown(merge_runs(stretch(rows, limit, cursor, collapse, ends, span), collapse)), limit, cursor)


def truncated(
    log: DataFrame, now: datetime, retention: timedelta, since: datetime | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Per volume: may older rows of the asked range have been pruned? ``stats``: see ``bounds.log_stats``."""
    cutoff = now - retention
    known = B.log_stats(log) if stats is None else stats
    oldest = known.select("volume", F.col("min_at").alias("oldest_at"))
    if since is not None:
        return oldest.withColumn("truncated", F.lit(since < cutoff))
    return oldest.withColumn("truncated", F.col("oldest_at") <= F.lit(cutoff + timedelta(minutes=5)))


def renamed_from(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the name a file was last displayed under, on its rename rows."""
    keys = [*_ITEM, "file_id"]
    seen = Ordered(rows, keys, "sequence", chunk_rows).look_back(last={"prev": F.struct("name")}).df
    return seen.select(
        *rows.columns, F.when(F.col("kind") == RENAMED, F.col("prev.name")).alias("renamed_from")
    )


def history_report(rows: DataFrame, now: datetime) -> DataFrame:
    """Text columns of displayed rows from :func:`renamed_from`."""
    renamed = F.when(
        F.col("kind") == RENAMED,
        F.when(F.col("renamed_from").isNull(), F.lit("Renamed")).otherwise(F.concat(F.lit("Renamed from "), F.col("renamed_from"))),
    )
    return rows.select(
        "volume",
        "sequence",
        "kind",
        "name",
        human_delta(F.col("size_delta")).alias("size_text"),
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"),
        relative_age(F.col("at"), F.lit(now)).alias("age"),
        F.coalesce(renamed, F.lit("")).alias("details"),
    )


def match_counts(log: DataFrame, volume: str, file_id: int) -> DataFrame:
    """All rows, rows of the id, and rows with it as parent, in one pass."""
    here = F.col("volume") == volume
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(here & (F.col("file_id") == file_id)).alias("matched"),
        F.count_if(here & (F.col("parent_file_id") == file_id)).alias("parent_matched"),
    )
