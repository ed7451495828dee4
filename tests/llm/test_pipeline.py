from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_line_dedup import brute as repeated_lines
from test_ngram_join import brute as near_copies

from ledgertree.llm import byte_bpe, mixing

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialize(stage(spark, seen[-1], SF_DIR), "stage"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = [{r.doc_id: r for r in x.collect()} for x in seen[:-1]]
    assert 0 < len(rows[1]) < len(rows[0])

    ids = sorted(rows[1])
    texts = [rows[1][i].text for i in ids]
    gone = repeated_lines(texts)
    left = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)]
    assert [rows[2][i].text for i in ids] == left

    groups = near_copies(left, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert set(rows[3]) == {ids[d] for d, v in groups.items() if v[1] == d}

    taken = {r.doc_id: r for r in mixing.taken_words(seen[3]).collect()}
    # Whole copies: the words the mix takes, fractions by a coin, so sources meet their targets in the mean.
    mixed = [r.doc_id for r in seen[4].collect()]
    for i, r in taken.items():
        low = r.taken // r.size if r.size else 0
        assert low <= mixed.count(i) <= low + bool(r.size and r.taken % r.size)
    whole = sum(r.taken for r in taken.values())
    assert abs(sum(taken[i].size for i in mixed) - whole) < 0.25 * whole

    words = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    last = seen[5].collect()
    assert len(last) == len(mixed)
    for r in last:
        text = rows[4][r.doc_id].text
        assert r.n_tokens == len(library.encode_ordinary(text))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
