"""Raw change-journal rows to log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgertree.schema import CREATED, DELETED, DIRECTORY, MODIFIED, RENAMED

# Reason bits of a journal row.
FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000

# Journal offsets spanned by one numbering window.
OFFSET_SPAN = 1_000_000


def classify_changes(raw: DataFrame) -> DataFrame:
    """Add ``kind`` and ``is_directory``; the same projection on batch and stream."""
    reason = F.col("reason")

    def has(bits: int):
        return reason.bitwiseAND(F.lit(bits)) != 0

    kind = (
        F.when(has(FILE_DELETE), F.lit(DELETED))
        .when(has(FILE_CREATE), F.lit(CREATED))
        .when(has(RENAME_OLD | RENAME_NEW), F.lit(RENAMED))
        .otherwise(F.lit(MODIFIED))
    )
    return raw.withColumn("kind", kind).withColumn(
        "is_directory", F.col("attributes").bitwiseAND(F.lit(DIRECTORY)) != 0
    )


def assign_sequence(
    batch: DataFrame, last: DataFrame | None = None, order: str = "usn", span: int = OFFSET_SPAN
) -> DataFrame:
    """Add a dense ``sequence`` per volume in journal order, continuing after ``last``.

    Offsets are unique per volume, so a window over one span of offsets is
    bounded whatever the volume's size; spans are then offset by the counts of
    the spans before them, one row per span.
    """
    cut = batch.withColumn("_span", F.floor(F.col(order) / span).cast("long"))
    counts = cut.groupBy("volume", "_span").agg(F.count("*").alias("n"))
    across = Window.partitionBy("volume").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("volume", "_span", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("_before"))
    if last is not None:
        offsets = offsets.join(last.select("volume", "last_sequence"), "volume", "left").select(
            "volume", "_span", (F.col("_before") + F.coalesce("last_sequence", F.lit(0))).alias("_before")
        )
    inner = Window.partitionBy("volume", "_span").orderBy(order)
    numbered = cut.withColumn("_rank", F.row_number().over(inner))
    return numbered.join(offsets, ["volume", "_span"]).select(
        (F.col("_before") + F.col("_rank")).cast("long").alias("sequence"), *batch.columns
    )
