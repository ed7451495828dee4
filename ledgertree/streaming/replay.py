"""Continuous replay: corrected log rows and maintained facts from a log stream.

Each micro-batch is folded with the batch operators, so it stays in the JVM and
splits hot files like any batch. Facts are a base table plus one small table of
changed facts per micro-batch; every ``FOLD_EVERY`` batches these are merged into
a new base. A micro-batch writes only folders named by its own number and reads
only earlier ones, so a retried batch gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ledgertree.operators import replay
from ledgertree.streaming import ONCE
from ledgertree.schema import FACTS
from ledgertree.sources.tables import conform

FOLD_EVERY = 20
#: The base and the changes lie in so many folders by hash of the file; a micro-batch
#: reads only those of the files it touches.
BUCKETS = 256

_KEYS = ["volume", "file_id"]
_REST = [c for c in FACTS.names if c not in _KEYS]
_BASE = StructType([*FACTS.fields, StructField("bucket", IntegerType())])
_CHANGES = StructType(
    [*FACTS.fields, StructField("alive", BooleanType()), StructField("batch", LongType()), StructField("bucket", IntegerType())]
)


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    bucket = F.pmod(F.xxhash64(*_KEYS), F.lit(BUCKETS)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def replay_stream(log: DataFrame, facts: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Fold a log stream over ``facts``; results are read with the functions below.

    Rows of a file must not arrive in an earlier micro-batch than the rows
    before them.
    """
    start = f"{sink}/base/0"
    _write(conform(facts, "facts"), start, "ignore")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        arrived = f"{sink}/arrived/{batch_id}"
        batch.write.mode("overwrite").parquet(arrived)
        rows = session.read.schema(batch.schema).parquet(arrived)
        touched = rows.select(*_KEYS).distinct()
        bucket = F.pmod(F.xxhash64(*_KEYS), F.lit(BUCKETS)).cast("int").alias("bucket")
        # At most BUCKETS numbers.
        buckets = [r.bucket for r in touched.select(bucket).distinct().collect()]
        known = _facts_before(session, sink, batch_id, buckets).join(touched, _KEYS, "left_semi")
        replay.correct_deltas(known, rows).write.mode("overwrite").parquet(f"{sink}/log/batch={batch_id}")
        after = conform(replay.replay(known, rows), "facts")
        changed = touched.join(after, _KEYS, "left").select(
            *FACTS.names, F.col("name").isNotNull().alias("alive")
        )
        _write(changed, f"{sink}/changes/batch={batch_id}")
        if (batch_id + 1) % FOLD_EVERY == 0:
            merged = _facts_before(session, sink, batch_id + 1)
            _write(merged, f"{sink}/base/{batch_id + 1}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def _facts_before(spark: SparkSession, sink: str, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
    """Facts before a micro-batch: the last base, overlaid by the changes since; of ``buckets`` only if given."""
    base_id = (batch_id - 1) // FOLD_EVERY * FOLD_EVERY if batch_id else 0
    mine = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
    base = spark.read.schema(_BASE).parquet(f"{sink}/base/{base_id}").filter(mine).select(*FACTS.names)
    if batch_id == base_id:
        return base
    # Only the folders since the base are listed.
    recent = [f"{sink}/changes/batch={b}" for b in range(base_id, batch_id)]
    changes = spark.read.schema(_CHANGES).option("basePath", f"{sink}/changes").parquet(*recent).filter(mine).drop("bucket")
    rows = base.withColumns({"alive": F.lit(True), "batch": F.lit(-1).cast("long")}).unionByName(changes)
    newest = rows.groupBy(*_KEYS).agg(F.max_by(F.struct("alive", *_REST), "batch").alias("r"))
    return newest.filter("r.alive").select(*_KEYS, *[f"r.{c}" for c in _REST]).select(*FACTS.names)


def corrected_log(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/log").drop("batch")


def current_facts(spark: SparkSession, sink: str, batches: int) -> DataFrame:
    """Facts after the first ``batches`` micro-batches."""
    return _facts_before(spark, sink, batches)
