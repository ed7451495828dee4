"""Two tokenizers aligned over all documents: op12."""

from __future__ import annotations

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.llm import token_alignment
from ledgertree.llm.registry import query, table

BYTE_LEVEL, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def vocabularies() -> token_alignment.Vocabularies:
    a, b, ranks = (public_tokenizers.path(x) for x in (BYTE_LEVEL, PIECES, RANKS))
    return token_alignment.Vocabularies.read(a, b, ranks, public_tokenizers.PATTERN)


def alignment_digests(docs: DataFrame, files: token_alignment.Vocabularies) -> DataFrame:
    aligned = token_alignment.align(docs, files)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    aligned = aligned.withColumn("groups_sha256", digest).drop("groups")
    size = sentencepiece.SentencePieceProcessor(model_proto=files.pieces).get_piece_size()
    found = token_alignment.with_link_counts(aligned, size)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_token_alignment")
def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"), vocabularies())
