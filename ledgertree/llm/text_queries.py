"""Queries over whole texts, one result row for each document: op2, op4, op10 and op11."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.llm import byte_bpe, language_id, pu_quality, quality_rules
from ledgertree.llm.registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def bpe_digests(docs: DataFrame) -> DataFrame:
    words = byte_bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    both = byte_bpe.round_trip(docs, words)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


@query("op4_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.train(docs))


@query("op11_pu_quality")
def pu_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pu_quality.scored(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))
