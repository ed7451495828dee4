"""Queries over embeddings: op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.llm import ann
from ledgertree.llm.registry import query, table


@query("op9_ann")
def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
