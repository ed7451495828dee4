"""Sequence windows (start, end] per volume, and applying them to a log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Up to this many volumes the window is a literal predicate, which reaches the
# partition pruning and the row-group statistics of the scan; more are joined. Both
# give the same rows: a row without volume is in no window and has no cursor.
LITERAL_VOLUMES = 64


class InsufficientHistory(ValueError):
    """The log does not reach back far enough."""


class WindowExpired(ValueError):
    """The window starts before the oldest row kept."""


def log_stats(log: DataFrame) -> DataFrame:
    """Ends of the log per volume: min and max of sequence and time.

    A table of one row per volume to keep beside the log: :func:`merge_stats` adds a
    batch of new rows, and a prune makes it anew for the volumes it touched. The
    functions below take it as ``stats`` and then need no pass over the log for an end.
    """
    return log.groupBy("volume").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("sequence", "at") for n, f in (("min", F.min), ("max", F.max))]
    )


def merge_stats(stats: DataFrame, more: DataFrame) -> DataFrame:
    return stats.unionByName(more).groupBy("volume").agg(
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("sequence", "at") for n, f in (("min", F.min), ("max", F.max))]
    )


def _ends(log: DataFrame, stats: DataFrame | None, column: str) -> DataFrame:
    known = log_stats(log) if stats is None else stats
    return known.select("volume", column)


def bounds_since(log: DataFrame, since: datetime, stats: DataFrame | None = None) -> DataFrame:
    """(volume, start_seq, end_seq] from the first row at or after ``since``.

    A volume without such a row gets no window. The time reaches the scan as a filter.
    """
    recent = log.filter(F.col("at") >= F.lit(since)).groupBy("volume").agg(F.min("sequence").alias("first"))
    return recent.join(_ends(log, stats, "max_sequence"), "volume").select(
        "volume", (F.col("first") - 1).alias("start_seq"), F.col("max_sequence").alias("end_seq")
    )


def bounds_between(volume_snapshots: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """(volume, start_seq, end_seq] of the volumes in both snapshots, either order."""
    seq = F.col("sequence_number")
    return (
        volume_snapshots.filter(F.col("parent_id").isin(id_a, id_b))
        .groupBy("volume")
        .agg(
            F.min(seq).alias("start_seq"),
            F.max(seq).alias("end_seq"),
            F.max(F.col("parent_id") == id_a).alias("a"),
            F.max(F.col("parent_id") == id_b).alias("b"),
        )
        .filter("a and b")
        .select("volume", "start_seq", "end_seq")
    )


class Windows:
    """A per-volume table of windows, fetched once while it is short."""

    def __init__(self, table: DataFrame):
        self.table = table.select("volume", "start_seq", "end_seq")
        self.rows = few(self.table)

    @property
    def literal(self) -> bool:
        return self.rows is not None

    def for_volume(self, volume: str) -> "Windows":
        narrowed = object.__new__(Windows)
        narrowed.table = self.table.filter(F.col("volume") == volume)
        narrowed.rows = None if self.rows is None else [r for r in self.rows if r.volume == volume]
        return narrowed

    def joinable(self) -> DataFrame:
        """The table for a join: broadcast while its counted size is small."""
        if self.rows is None:
            return self.table
        return F.broadcast(self.table.sparkSession.createDataFrame(self.rows, self.table.schema))


def few(table: DataFrame) -> list | None:
    """All rows of a table of volumes, or None if they are more than LITERAL_VOLUMES."""
    rows = table.limit(LITERAL_VOLUMES + 1).collect()
    return rows if len(rows) <= LITERAL_VOLUMES else None


def listed(rows: list) -> Column:
    """Whether the volume is one of those of ``rows``; never NULL."""
    names = [r.volume for r in rows if r.volume is not None]
    return F.coalesce(F.col("volume").isin(names), F.lit(False))


def windows(bounds: "DataFrame | Windows") -> Windows:
    return bounds if isinstance(bounds, Windows) else Windows(bounds)


def _keep(log: DataFrame, bounds: "DataFrame | Windows", test) -> DataFrame:
    """Log rows for which ``test(start_seq, end_seq)`` holds in their volume."""
    known = windows(bounds)
    if known.literal:
        condition = F.lit(False)
        for row in known.rows:
            condition = condition | (
                (F.col("volume") == row.volume) & test(F.lit(row.start_seq), F.lit(row.end_seq))
            )
        return log.filter(condition)
    joined = log.join(known.joinable(), "volume")
    return joined.filter(test(F.col("start_seq"), F.col("end_seq"))).select(*log.columns)


def drop_volumes(df: DataFrame, volumes: DataFrame) -> DataFrame:
    """Rows of ``df`` whose volume is not listed."""
    rows = few(volumes.select("volume").distinct())
    if rows is not None:
        return df.filter(~listed(rows))
    return df.join(volumes.select("volume"), "volume", "left_anti")


def in_window(log: DataFrame, bounds: "DataFrame | Windows") -> DataFrame:
    """Log rows inside the windows."""
    return _keep(log, bounds, lambda start, end: (F.col("sequence") > start) & (F.col("sequence") <= end))


def before_window(log: DataFrame, bounds: "DataFrame | Windows") -> DataFrame:
    """Log rows up to the start of the windows."""
    return _keep(log, bounds, lambda start, end: F.col("sequence") <= start)


def after_cursor(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Log rows a replay has not consumed; a volume without cursor is read whole."""
    table = cursors.select("volume", "last_sequence").filter("volume is not null and last_sequence is not null")
    rows = few(table)
    if rows is not None:
        condition = ~listed(rows)
        for r in rows:
            condition = condition | ((F.col("volume") == r.volume) & (F.col("sequence") > r.last_sequence))
        return log.filter(condition)
    return (
        log.join(table, "volume", "left")
        .filter("last_sequence is null or sequence > last_sequence")
        .select(*log.columns)
    )


def history_findings(log: DataFrame, since: datetime, now: datetime, stats: DataFrame | None = None) -> DataFrame:
    """Days of log per volume against the days asked for."""
    needed = (now - since).total_seconds() / 86400
    available = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("min_at")) / 86400.0
    found = _ends(log, stats, "min_at").select("volume", F.round(available, 4).alias("days_available"))
    return found.select(
        "volume",
        "days_available",
        F.round(F.lit(needed), 4).alias("days_needed"),
        (F.col("days_available") >= F.round(F.lit(needed), 4)).alias("sufficient"),
    )


def check_history(log: DataFrame, since: datetime, now: datetime, stats: DataFrame | None = None) -> None:
    short = history_findings(log, since, now, stats).filter("not sufficient").orderBy("days_available").first()
    if short:
        missing = -int(-(short.days_needed - short.days_available) // 1)
        raise InsufficientHistory(
            f"{short.volume}: {int(short.days_available)} days of history, {missing} more needed"
        )


def window_findings(
    log: DataFrame, bounds: "DataFrame | Windows", stats: DataFrame | None = None
) -> DataFrame:
    """Whether each window starts before the oldest log row still kept."""
    oldest = _ends(log, stats, "min_sequence").withColumnRenamed("min_sequence", "oldest_seq")
    joined = windows(bounds).joinable().join(oldest, "volume", "left")
    joined = joined.withColumn("oldest_seq", F.coalesce("oldest_seq", F.lit(0)))
    return joined.select(
        "volume",
        "start_seq",
        "oldest_seq",
        ((F.col("start_seq") < F.col("oldest_seq")) & (F.col("oldest_seq") > 1)).alias("expired"),
    )


def check_window(log: DataFrame, bounds: "DataFrame | Windows", stats: DataFrame | None = None) -> None:
    late = window_findings(log, bounds, stats).filter("expired").first()
    if late:
        raise WindowExpired(f"{late.volume}: window starts at {late.start_seq}, oldest row kept is {late.oldest_seq}")
