from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import DOCS, corpus, documents
from tokenizers import Tokenizer

from ledgertree.llm import token_alignment as ta
from ledgertree.llm import token_queries
from ledgertree.llm.registry import ship

ODD = [
    None, "", " ", "a▁b", "<|endoftext|> and <s>x</s>", "<0x41>", "tab\tand\nline\r\n", "two  spaces   three ",
    " lead", "é é ﬁ ½", "\x00a", "日本語 テキスト", "😀 mixed 😀text", "don't we'll I'm", "१२३ 123", "x" * 500, "ſ'S ’s",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_chars():
    """Byte of each character, from the vocabulary's own single-character tokens, in byte order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(extra)] = b
            extra += 1
    return out


def brute_tokens(text, libraries):
    a, b = libraries
    if not text:
        return [], []
    chars = byte_chars()
    own = a.encode(" " + text, add_special_tokens=False)
    all_a = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in own.ids]
    all_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        all_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (all_a, all_b)):
        return [], []
    return all_a, all_b


def brute(texts, libraries):
    """Groups by common ends, links by comparing all ends, counts over all texts."""
    rows, counts = [], Counter()
    for text in texts:
        sides = []
        for side in brute_tokens(text, libraries):
            at, spans = 0, []
            for i, x in side:
                at += len(x)
                spans.append((i, at))
            sides.append(spans)
        links = [(i, j) for i, x in sides[0] for j, y in sides[1] if x == y]
        counts.update(links)
        cuts = sorted({x for _, x in sides[0]} & {y for _, y in sides[1]})
        shown, low = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for i, x in side if low < x <= cut) for side in sides))
            low = cut
        rows.append((sides, links, ";".join(shown), len(cuts)))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for sides, links, shown, cuts in rows:
        n_best = sum(counts[x] == top[x[1]] for x in links)
        digest = hashlib.sha256(shown.encode()).hexdigest() if sides[0] else ""
        out.append((len(sides[0]), len(sides[1]), cuts, len(links), n_best, sum(counts[x] for x in links), digest))
    return out


def test_components_against_overlap_graph():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 40)
        ends = [np.array(sorted({n, *r.sample(range(1, n + 1), r.randint(0, n))})) for _ in range(2)]
        spans = [(k, s, e) for k in (0, 1) for s, e in zip([0, *ends[k][:-1].tolist()], ends[k].tolist(), strict=True)]
        label = {x: i for i, x in enumerate(spans)}
        for _ in spans:  # spread the smallest label along overlaps
            for x in spans:
                for y in spans:
                    if x[0] != y[0] and x[1] < y[2] and y[1] < x[2]:
                        label[x] = label[y] = min(label[x], label[y])
        got = np.concatenate(ta.components(*ends)).tolist()
        assert len({(g, label[x]) for g, x in zip(got, spans, strict=True)}) == len(set(got)) == len(set(label.values()))


def test_query_against_brute_force(spark, libraries):
    ship(spark)
    texts = ODD + corpus(7, 40) + corpus(8, 20)
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id between 5 and 8"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id, twice the text", None, None, None)] * 2, DOCS))
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    expected = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], libraries), strict=True)), key=str)
    assert any(x[1] == 0 and t for x, (_, t) in zip(expected, rows, strict=True)) and any(x[1] for x in expected)
    files = token_queries.vocabularies()
    for parts in (1, 5):
        got = token_queries.alignment_digests(docs.repartition(parts), files).collect()
        assert sorted((tuple(x) for x in got), key=str) == expected
    assert token_queries.alignment_digests(docs.limit(0), files).collect() == []


def test_fast_library_agrees_on_latin(libraries):
    r = random.Random(2)
    latin = [chr(c) for c in range(0x250)]
    fast = ta.ByteLevel(*(open(public_tokenizers.path(x), "rb").read() for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = [f"{x}{c}{c}{x} {c}{x}  {c}" for c in latin for x in "a1. '\n"]
    texts += ["".join(r.choice(latin + [" "] * 200 + list("aest'13.\n") * 20) for _ in range(60)) for _ in range(3000)]
    for text, x in zip(texts, libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False), strict=True):
        assert fast.encode(text).tolist() == x.ids


def test_segments_give_the_ids_of_the_whole(libraries, monkeypatch):
    r = random.Random(3)
    parts = ["the", "end", "été", "日本", " ", "\n", "  ", "😀", "123", ".", "▁", "'s", "x" * 9]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(80)) for _ in range(200)]
    whole = ta.Aligner(token_queries.vocabularies()).align(texts)
    monkeypatch.setattr(ta.segments, "__defaults__", (7,))
    assert any(len(ta.segments(t)) > 5 for t in texts) and all(" ".join(ta.segments(t)) == t for t in texts)
    cut = ta.Aligner(token_queries.vocabularies()).align(texts)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut, strict=True))


def test_blocks_above_two_byte_indices():
    assert ta.index_type(1 << 16) == "<u2" and ta.index_type((1 << 16) + 1) == "<u4"


def test_clashing_columns(spark):
    ship(spark)
    docs = documents(spark, ["one two", None])
    docs = docs.selectExpr("*", *(f"1 as {c}" for c in "n_a n_b n_groups groups block links pairs times pair at n best b _id".split()))
    found = token_queries.alignment_digests(docs, token_queries.vocabularies()).collect()
    assert sorted((x.doc_id, x.n_groups, x.count_sum) for x in found) == [(0, 2, 2), (1, 0, 0)]
