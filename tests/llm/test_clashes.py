"""Inputs whose extra columns are named as results or intermediates, with repeated and null rows."""

from __future__ import annotations

import public_tokenizers
from helpers import corpus, documents
from pyspark.sql import functions as F

from ledgertree.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join, quality_rules, suffix_dedup
from ledgertree.llm.registry import ship

EXTRA = (
    "component_id set_id n_shingles kept score taken size source_size target sid start block words times removed n ids"
    " decoded doc line_no prefix token held_out lang_pred n_bytes ranges trigger pair side cluster id root label"
    " _id _doc _gone _own _row _source _share _times _copy _set _open _size _token row gone point alive"
).split()


def test_every_operator_over_documents(spark):
    ship(spark)
    docs = documents(spark, corpus(11, 25))
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(
        spark.createDataFrame([(None, "no id at all here", None, None, None)], docs.schema)
    )
    docs = docs.withColumns({name: F.lit(1) for name in EXTRA})
    n = docs.count()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    words = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    model = quality_rules.train(docs, labels)
    results = [
        quality_rules.judged(docs, model),
        language_id.predicted(docs, language_id.train(docs)),
        mixing.taken_words(docs),
        ngram_join.classes(docs),
        line_dedup.report(docs),
        suffix_dedup.deduplicated(docs),
        byte_bpe.decode(byte_bpe.encode(docs, words), words),
    ]
    for result in results:
        rows = [tuple(r) for r in result.collect()]
        assert len(rows) == n
        # Repeated rows get equal results.
        by_id = {}
        for row, i in zip(rows, (r.doc_id for r in result.select("doc_id").collect()), strict=True):
            by_id.setdefault(i, set()).add(tuple(map(str, row)))
        if "taken" not in result.columns:
            assert all(len(found) == 1 for found in by_id.values())
    for kept in (quality_rules.keep_good(docs, model), line_dedup.without_repeats(docs), ngram_join.one_of_each(docs), mixing.mixed(docs)):
        assert kept.columns == docs.columns
        kept.collect()
