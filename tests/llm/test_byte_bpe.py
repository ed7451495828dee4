from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import corpus, documents

from ledgertree.llm import byte_bpe, text_queries
from ledgertree.llm.registry import ship


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def texts():
    r = random.Random(1)
    odd = ["a\x1cb \x1c\x1d x\x85y \xa0z", "x" * 3000, " \n\n  \t", "日本語 😀 é", "aaaa'S 'll don't", "<|endoftext|>", "\0\0"]
    mixed = ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x3040, 0x30FF), 32, 10, 0x85])) for _ in range(80)) for _ in range(150)]
    return corpus(2) + odd + mixed


def test_perfect_hash(vocabulary):
    r = np.random.RandomState(1)
    for n in (1, 2, 3, 10, 1000):
        keys = np.unique(r.randint(0, 1 << 62, n)).astype(np.uint64)
        assert sorted(byte_bpe.PerfectHash(keys).slot(keys).tolist()) == list(range(len(keys)))
    assert all(vocabulary.tokens) and len(set(vocabulary.tokens)) == len(vocabulary.ranks)


def test_against_the_library(spark, vocabulary, library):
    ship(spark)
    own = texts()
    docs = documents(spark, own).withColumnRenamed("lang", "ids").repartition(4)
    rows = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(rows) == len(own)
    for r in rows:
        text = own[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_cache_may_overflow(monkeypatch, vocabulary, library):
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    own = texts()
    for text, ids in zip(own, byte_bpe.encode_texts(own, vocabulary), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")


def test_empty_table(spark, vocabulary):
    ship(spark)
    assert byte_bpe.encode(documents(spark, ["a"]).limit(0), vocabulary).collect() == []


def test_digests_take_one_python_step(spark, vocabulary):
    ship(spark)
    docs = documents(spark, corpus(7, 30) + [None, "", "<|endoftext|> é"])
    plan = text_queries.bpe_digests(docs)._jdf.queryExecution().executedPlan().toString()
    # Each such step of a stage has a Python worker of its own for every task.
    assert plan.count("MapInArrow") == 1
    both = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    assert sorted(map(tuple, byte_bpe.round_trip(docs, vocabulary).collect())) == sorted(map(tuple, both.collect()))
    assert byte_bpe.round_trip(docs.limit(0), vocabulary).collect() == []
