from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import DOCS, corpus, documents, lowered, words

from ledgertree.llm import line_dedup
from ledgertree.llm.arrays import U64, randoms
from ledgertree.llm.registry import ship


def many_lines(seed):
    r = random.Random(seed)
    vocab = [f"{'abcdefgh'[i % 8]}{i}" for i in range(150)]
    lines, texts = [], []
    for _ in range(40):
        own = []
        for _ in range(r.randint(1, 6)):
            line = " ".join(r.choice(vocab) for _ in range(r.randint(1, 25)))
            if lines and r.random() < 0.5:
                parts = r.choice(lines).split(" ")
                for _ in range(r.randint(0, 3)):
                    parts[r.randrange(len(parts))] = r.choice(vocab)
                r.shuffle(parts)
                line = " ".join(parts)
            lines.append(line)
            own.append(line)
        texts.append("\n".join(own))
    return texts


def brute(texts):
    rows = [
        (d, i, set(words(lowered(line))))
        for d, t in enumerate(texts)
        for i, line in enumerate((t or "").split("\n"))
        if len(words(line)) >= line_dedup.MIN_WORDS
    ]
    gone = {d: [] for d in range(len(texts))}
    for k, (d, i, own) in enumerate(rows):
        if any(100 * len(own & x) >= line_dedup.PERCENT * len(own | x) for _, _, x in rows[:k]):
            gone[d].append(i)
    return gone


@pytest.mark.parametrize("make", [lambda: many_lines(1), lambda: many_lines(2), lambda: corpus(5, 80)])
def test_against_all_pairs(spark, make):
    ship(spark)
    texts = make()
    docs = documents(spark, texts).repartition(6)
    rows = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    expected = brute(texts)
    assert {d: r.removed for d, r in rows.items()} == expected
    assert all(r.n_removed == len(expected[d]) for d, r in rows.items())
    assert all(r.n_lines == (0 if texts[d] is None else texts[d].count("\n") + 1) for d, r in rows.items())
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    for d, text in enumerate(texts):
        lines = None if text is None else [x for i, x in enumerate(text.split("\n")) if i not in expected[d]]
        assert kept[d] == (None if lines is None else "\n".join(lines))


def test_empty_table(spark):
    ship(spark)
    assert line_dedup.report(documents(spark, ["a"]).limit(0)).collect() == []


def test_short_lines_go_too(spark):
    ship(spark)
    texts = ["yes\n\nsee more\na b c d e", "YES\n \nmore see more\nno", "a b c d\nb c d\nno\nd c b\nyes no"]
    rows = {r.doc_id: r.removed for r in line_dedup.report(documents(spark, texts)).collect()}
    # Four of five words are 80 %, three of four are not; lines without words stay.
    assert rows == {0: [], 1: [0, 2], 2: [0, 2, 3]}
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(documents(spark, texts)).collect()}
    assert kept == {0: texts[0], 1: " \nno", 2: "b c d\nyes no"}


def test_rows_of_one_id_and_of_none_keep_what_only_they_have(spark):
    ship(spark)
    common = "a line that stands in several rows here"
    rows = [
        (None, f"{common}\nkeep one two three four"), (None, f"{common}\nunrelated words that must stay here"),
        (None, f"other words first\n{common}"), (None, None), (None, ""),
        (7, f"{common}\nfirst text of seven"), (7, f"second text of seven\nnothing else in it"), (7, f"second text of seven\nnothing else in it"),
        (8, "nothing else in it\nall new words"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    left = sorted((r.text or "-") for r in line_dedup.without_repeats(docs).collect())
    text = "\n".join(left)
    # One row keeps the common line, no row loses a line that no earlier row has.
    assert text.count(common) == 1
    for line in ("keep one two three four", "unrelated words that must stay here", "other words first", "first text of seven", "all new words"):
        assert text.count(line) == 1
    assert text.count("second text of seven") == 2 and "\nnothing else in it\nall" not in text
    assert sorted(r.n_removed for r in line_dedup.report(docs).collect()) == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_sketches_tell_large_sets_apart():
    # Bitmaps of 128 hashed words are nearly full at this size, and most unlike sets passed.
    n, count = 200, 60
    low, high = line_dedup.sketches(np.full(count, n), randoms(n * count, 5))
    a, b = np.triu_indices(count, 1)
    apart = sum(np.bitwise_count((x[a] ^ x[b]).view(U64)).astype(int) for x in (low, high))
    need = -(-line_dedup.PERCENT * 2 * n // (100 + line_dedup.PERCENT))
    assert (apart <= 2 * n - 2 * need).mean() < 0.02


def test_sketches_never_part_like_sets():
    words = randoms(260, 6)
    low, high = line_dedup.sketches(np.array([220, 220]), np.concatenate((words[:220], words[20:240])))
    assert sum(int(np.bitwise_count((x[0:1] ^ x[1:2]).view(U64))[0]) for x in (low, high)) <= 40


def test_report_moves_no_texts(spark):
    ship(spark)
    found = line_dedup.report(documents(spark, ["a b c d e\nf", "a b c d e"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "text#" not in plan.split("Join")[0]


def test_second_round_finds_what_the_nearest_one_is_not(spark, monkeypatch):
    def blank(sizes, token):
        return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    ship(spark)
    r = random.Random(4)
    texts = many_lines(8)
    # Many lines just below and above the threshold of one another.
    base = [f"w{i}" for i in range(20)]
    for _ in range(60):
        own = [w if r.random() > 0.12 else f"v{r.randrange(12)}" for w in base]
        texts.append(" ".join(own))
    opened = []
    marks = line_dedup.marks
    monkeypatch.setattr(line_dedup, "marks", lambda keys, size: opened.append(size) or marks(keys, size))
    # Sketches of no use: any row met may count as the nearest, and it is often not alike.
    monkeypatch.setattr(line_dedup, "sketches", blank)
    rows = {x.doc_id: x.removed for x in line_dedup.report(documents(spark, texts).repartition(5)).collect()}
    assert rows == brute(texts)
    assert line_dedup.MAX_MARKS >> 3 in opened


def test_a_task_gives_a_class_again_only_for_earlier_lines():
    leads = line_dedup.Leads()
    ids, row = np.array([5, 5, 9, 5]), np.zeros(4, np.int64)
    assert leads.lead(ids, np.array([3, 2, 3, 2]), np.array([0, 4, 1, 3]), row).tolist() == [False, False, True, True]
    assert leads.lead(ids, np.array([2, 2, 3, 1]), np.array([3, 2, 1, 9]), row).tolist() == [False, False, False, True]
    assert leads.lead(ids[:2], np.array([1, 2]), np.array([9, 0]), row[:2]).tolist() == [False, False]


def test_postings_come_packed(spark):
    ship(spark)
    texts = [" ".join(f"w{(i * 7 + k) % 900}" for k in range(30)) for i in range(300)]
    docs = documents(spark, texts)
    lines = line_dedup.line_table(docs, line_dedup.rarity(docs))
    found = line_dedup.postings(lines, 4).collect()
    words = sum(len(r.prefix) for r in lines.collect())
    assert sum(r["count"] for r in found) == words > 100 * len({r.bucket for r in found})
    assert len(found) <= 4 * lines.rdd.getNumPartitions()
    assert all(len(r.token) % r["count"] == 0 and len(r.bits) == 8 * r["count"] for r in found)


def test_rarity_counts_every_word(spark):
    ship(spark)
    rank = line_dedup.rarity(documents(spark, ["a b a\nb c", None, "C d"]).repartition(3))
    of = {w: int(rank[line_dedup.counters(line_dedup.Lines([w.encode()]).token)[0]]) for w in "abcd"}
    assert of == {"a": 2, "b": 2, "c": 2, "d": 1} and int(rank.sum()) == 7
