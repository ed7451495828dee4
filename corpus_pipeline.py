"""Five stages from raw documents to token ids, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps with the columns they came with, the last one the digests of the
encoded texts. ``run`` applies them in order.

1. quality rules: documents that the rules reject go.
2. line dedup: lines that repeat an earlier one go; documents stay, if need be without text.
3. n-gram join: of each group of near copies (5-word shingles, 80 % alike) the document with the smallest id stays.
4. mixing: each document comes as often as the mix takes its words, fractions by a coin.
5. byte-level BPE: ids and decoded bytes of each text, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgertree.llm import line_dedup, mixing, ngram_join, quality_rules, text_queries
from ledgertree.llm.registry import shipped, table
from ledgertree.session import materialize

#: The first stage is a trained model, which SQL cannot express; tests/llm checks the stages.
ORACLE_SQL = None

#: Shingle length and similarity of near copies; those of op6 bind the query alone.
NEAR_WORDS, NEAR_PERCENT = 5, 80


@shipped
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


@shipped
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@shipped
def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return text_queries.bpe_digests(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
