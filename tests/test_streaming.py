from __future__ import annotations

import models
import pytest

from ledgertree.operators import replay
from ledgertree.schema import FACTS
from ledgertree.streaming import replay as stream


@pytest.mark.parametrize("fold_every", [1, 2, 20])
def test_folding_a_stream_equals_a_batch(spark, tmp_path, monkeypatch, fold_every):
    monkeypatch.setattr(stream, "FOLD_EVERY", fold_every)
    facts, log = models.random_log(9, files=25, most=6)
    facts_df = spark.createDataFrame(facts, models.FACT_DDL)
    log_df = spark.createDataFrame(log, models.LOG_DDL)
    source, sink = f"{tmp_path}/log", f"{tmp_path}/out"
    third = len(log) // 3
    for i in range(3):
        high = len(log) if i == 2 else third * (i + 1)
        piece = log_df.filter(f"sequence > {third * i} and sequence <= {high}")
        piece.coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema(log_df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.replay_stream(reader, facts_df, sink, f"{tmp_path}/ck").awaitTermination()
    state, deltas = models.replay(facts, log)
    assert {r.sequence: r.size_delta for r in stream.corrected_log(spark, sink).collect()} == deltas
    assert {tuple(r) for r in stream.current_facts(spark, sink, 3).select(*FACTS.names).collect()} == state


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    facts, log = models.random_log(10, files=25, most=6)
    facts_df = spark.createDataFrame(facts, models.FACT_DDL)
    log_df = spark.createDataFrame(log, models.LOG_DDL)
    source, sink = f"{tmp_path}/log", f"{tmp_path}/out"
    log_df.coalesce(1).write.parquet(source)
    reader = spark.readStream.schema(log_df.schema).parquet(source)
    query = stream.replay_stream(reader, facts_df, sink, f"{tmp_path}/ck", trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    query.stop()
    state, _ = models.replay(facts, log)
    assert {tuple(r) for r in stream.current_facts(spark, sink, 1).select(*FACTS.names).collect()} == state
    some = stream._facts_before(spark, sink, 1, [3, 7])
    rows = {tuple(r) for r in some.select(*FACTS.names).collect()}
    assert rows <= state and len(rows) < len(state)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan
