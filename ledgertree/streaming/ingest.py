"""Tailing a change journal into the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgertree.streaming import ONCE
from ledgertree.schema import DRAIN_STATE, RAW_CHANGES
from ledgertree.sources.journal import assign_sequence, classify_changes


def read_journal(
    spark: SparkSession, path: str, schema: StructType = RAW_CHANGES, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_stream(raw: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append classified, numbered rows to ``sink/log``.

    The stream's checkpoint is the journal cursor. Each micro-batch writes its
    own folder and the volumes' last sequences, and reads those of the batch
    before, so a retried batch rewrites the same rows.
    """
    spark = raw.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        last = (
            session.read.schema(DRAIN_STATE).parquet(f"{sink}/cursor/{batch_id - 1}")
            if batch_id > 0
            else session.createDataFrame([], DRAIN_STATE)
        )
        target = f"{sink}/log/batch={batch_id}"
        assign_sequence(classify_changes(batch), last).write.mode("overwrite").parquet(target)
        ends = session.read.parquet(target).groupBy("volume").agg(F.max("sequence").alias("last_sequence"))
        both = last.unionByName(ends).groupBy("volume").agg(F.max("last_sequence").alias("last_sequence"))
        both.write.mode("overwrite").parquet(f"{sink}/cursor/{batch_id}")

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def read_log(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/log").drop("batch")
