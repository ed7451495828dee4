"""Queries that find copies: op1, op6 and op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.llm import line_dedup, ngram_join, suffix_dedup
from ledgertree.llm.registry import query, table


@query("op6_ngram_join")
def ngram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


@query("op1_suffix_dedup")
def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
