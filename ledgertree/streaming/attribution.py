"""Install and runtime footprints from a live event stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ledgertree.operators import attribution as A
from ledgertree.operators.ordered import as_of
from ledgertree.streaming import ONCE

# One row per event; type is start, stop, file or registry.
EVENTS = StructType(
    [StructField("ts", TimestampType()), StructField("type", StringType()), StructField("pid", LongType()),
     StructField("ppid", LongType()), StructField("image", StringType()), StructField("event_id", IntegerType()),
     StructField("path", StringType()), StructField("key_name", StringType()),
     StructField("value_name", StringType()), StructField("data", StringType())]
)


def processes(events: DataFrame) -> DataFrame:
    """Start rows with the first stop of the pid at or after them."""
    starts = events.filter("type = 'start'").select("pid", "ppid", "image", F.col("ts").alias("started"))
    stops = events.filter("type = 'stop'").select("pid", F.col("ts").alias("stopped"))
    ended = as_of(starts, stops, ("pid", "started"), ("pid", "stopped"), "stop", forward=True)
    return ended.select("pid", "ppid", "image", "started", F.col("stop.stopped").alias("stopped"))


def file_events(events: DataFrame) -> DataFrame:
    return events.filter("type = 'file'").select("ts", "pid", "event_id", "path")


def registry_events(events: DataFrame) -> DataFrame:
    return events.filter("type = 'registry'").select("ts", "pid", "key_name", "value_name", "data")


def attribution_stream(
    events: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
    max_age: timedelta | None = None,
) -> StreamingQuery:
    """Write footprints of sessions as they close, and runtime artifacts as they happen.

    Events arrive in time order. A micro-batch is joined with what the batches
    before left open: processes still running and the events of sessions not yet
    closed. That remainder is a written table, so the work is ordinary joins over
    many tasks, also when one machine or process sends most of the events, and a
    retried batch rewrites the same folders.

    With ``max_age`` a process that never reports its stop is closed as expired once
    it is that much older than the newest event; such processes are written to
    ``sink/expired``, and what is carried on is bounded by that span.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.select(*EVENTS.names)
        known = fresh
        if batch_id > 0:
            known = fresh.unionByName(session.read.schema(EVENTS).parquet(f"{sink}/open/{batch_id - 1}"))
        members_path = f"{sink}/members/{batch_id}"
        A.session_members(processes(known)).write.mode("overwrite").parquet(members_path)
        members = session.read.parquet(members_path)

        A.install_footprints(members, file_events(known), registry_events(known)).write.mode("overwrite").parquet(
            f"{sink}/install/batch={batch_id}"
        )
        A.runtime_artifacts(members, file_events(fresh)).write.mode("overwrite").parquet(
            f"{sink}/runtime/batch={batch_id}"
        )

        still = A.install_sessions(members).filter("closed_at is null").select("root_key")
        lasting = members.filter("stopped is null and root_key is null").unionByName(
            members.join(still, "root_key", "left_semi").select(*members.columns)
        )
        if max_age is not None:
            newest = known.agg(F.max("ts")).first()[0]
            old = F.col("started") < F.lit(newest - max_age)
            lasting.filter(old).write.mode("overwrite").parquet(f"{sink}/expired/batch={batch_id}")
            lasting = lasting.filter(~old)
        lives = lasting.select("pid", "started", "stopped", "root_key")
        placed = as_of(known, lives, ("pid", "ts"), ("pid", "started"), "life")
        kept = placed.filter(
            F.col("life").isNotNull()
            & (F.col("life.stopped").isNull() | (F.col("ts") <= F.col("life.stopped")))
            & (F.col("type").isin("start", "stop") | F.col("life.root_key").isNotNull())
        )
        kept.select(*EVENTS.names).write.mode("overwrite").parquet(f"{sink}/open/{batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def install_table(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.parquet(f"{sink}/install")
    return rows.groupBy("app_name", "file_path").agg(F.max("install_time").alias("install_time"))


def runtime_table(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.parquet(f"{sink}/runtime")
    return rows.groupBy("process_name", "target_path").agg(F.max("access_time").alias("access_time"))
