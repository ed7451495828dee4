"""Language identification by a linear-chain conditional random field over words.

A word's score per language is the sum of the weights of its hashed features: affixes of
one to four bytes, n-grams of one to three bytes with the word's edges, and whole words of
a lexicon (words seen at least ``LEXICON_TIMES`` times in training). Learned transitions
join neighbouring words, and forward-backward gives each word's probabilities, so that
texts which switch language are labelled word by word. A text's language is the one with
the largest mean probability over its words; that mean is the score.

Training sees at most ``SAMPLE`` labelled documents, those with the smallest hash of their
id, whatever the size of the table. Their words are spliced into sequences that switch
language, so the transitions are learned too. Words without a letter are left out; a text
that is null or has no letter is ``und`` with score 0, as is every text when nothing is
labelled. A-Z is lower-cased. Repeated rows get equal results; no rows give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.llm.arrays import U64, Words, chunks, mix, spans

SAMPLE = 600
SEQUENCE = 60
SEQUENCES = 2_000
PIECE = (4, 30)
BUCKETS = 1 << 16
LEXICON_TIMES = 3
STEPS = 30
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True


class Tokens:
    """Words with a letter, in order; ``kind`` numbers the distinct ones."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        letters = np.concatenate(([0], np.cumsum(_LETTER_BYTE[w.buf])))
        good = letters[w.end] > letters[w.start]
        self.run = w.run
        self.doc = w.doc[good]
        self.word, lead, self.kind = np.unique(w.hash[good], return_index=True, return_inverse=True)
        self.start, self.end = w.start[good][lead], w.end[good][lead]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, feature) of all affixes and n-grams of the distinct words."""
        start, end = self.start, self.end
        of = np.arange(len(start))
        size = end - start
        owners, marks = [], []

        def add(owner: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> None:
            owners.append(owner)
            marks.append(mix(spans(self.run, a, b) + U64(salt)))

        for k in range(1, 5):
            long = size >= k
            add(of[long], start[long], start[long] + k, 100 + k)
            add(of[long], end[long] - k, end[long], 200 + k)
        for k in range(1, 4):
            count = np.maximum(size - k + 1, 0)
            owner = np.repeat(of, count)
            a = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + start[owner]
            add(owner, a, a + k, 300 + k)
        return np.concatenate(owners), np.concatenate(marks)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """Scores of each distinct word for each language."""
        owner, mark = featured(tokens, self.lexicon)
        return summed(owner, self.weights[mark], len(tokens.word))

    def label(self, tokens: Tokens, texts: int) -> np.ndarray:
        """Mean probability of each language in each text; zeros without words."""
        totals = np.zeros((texts, len(self.languages)))
        probabilities = marginals(self.emissions(tokens)[tokens.kind], tokens.doc, texts, self.transitions)
        for i in range(totals.shape[1]):
            totals[:, i] = np.bincount(tokens.doc, probabilities[:, i], texts)
        return totals / np.maximum(np.bincount(tokens.doc, minlength=texts), 1)[:, None]


def featured(tokens: Tokens, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, bucket) of all features."""
    owner, mark = tokens.features()
    known = np.flatnonzero(np.isin(tokens.word, lexicon))
    owner = np.concatenate((owner, known))
    mark = np.concatenate((mark, mix(tokens.word[known] + U64(400))))
    return owner, (mark % U64(BUCKETS)).astype(np.int64)


def summed(owner: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    return np.column_stack([np.bincount(owner, rows[:, i], count).astype(float) for i in range(rows.shape[1])])


def marginals(
    scores: np.ndarray, doc: np.ndarray, texts: int, transitions: np.ndarray, steps: np.ndarray | None = None
) -> np.ndarray:
    """Probabilities of each word's labels by forward-backward; texts advance side by side, longest first.

    The expected number of each transition is added to ``steps`` if given.
    """
    size = np.bincount(doc, minlength=texts)
    rank = np.empty(texts, np.int64)
    order = np.argsort(-size, kind="stable")
    rank[order] = np.arange(texts)
    longest = int(size.max()) if texts else 0
    # active[t]: texts with more than t words; words are laid out by place, then by text.
    active = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
    offset = np.concatenate(([0], np.cumsum(active)))
    first = np.cumsum(size) - size
    place = np.arange(len(doc)) - first[doc]
    spot = offset[place] + rank[doc]
    e = np.empty_like(scores)
    e[spot] = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(transitions - transitions.max())
    ahead = np.empty_like(e)
    now = None
    for t in range(longest):
        a, b = offset[t], offset[t + 1]
        now = e[a:b] if now is None else (now[: b - a] @ step) * e[a:b]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[a:b] = now
    back = np.ones((0, scores.shape[1]))
    for t in range(longest - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        after = np.ones((b - a, scores.shape[1]))
        if len(back):
            after[: len(back)] = back
        ahead[a:b] *= after
        here = after * e[a:b]
        if steps is not None and t:
            pair = ahead[offset[t - 1] : offset[t - 1] + b - a, :, None] * step * here[:, None, :]
            steps += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = here @ step.T
        back = back / back.sum(axis=1, keepdims=True)
    ahead /= ahead.sum(axis=1, keepdims=True)
    return ahead[spot]


def fit(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 1) -> Model | None:
    """Maximise the likelihood of spliced sequences; None without labelled words."""
    tokens = Tokens([t.encode() for t in texts])
    if not len(tokens.doc):
        return None
    languages = sorted(set(labels))
    n = len(languages)
    label_of = np.array([languages.index(x) for x in labels])[tokens.doc]
    times = np.bincount(tokens.kind)
    lexicon = tokens.word[times >= LEXICON_TIMES]
    owner, mark = featured(tokens, lexicon)

    r = np.random.RandomState(seed)
    # Every language is drawn alike, so a rare one is learned as well.
    by_label = [np.flatnonzero(label_of == i) for i in range(n)]
    by_label = [x for x in by_label if len(x)]
    word = np.zeros((SEQUENCES, SEQUENCE), np.int64)
    truth = np.zeros((SEQUENCES, SEQUENCE), np.int64)
    for row in range(SEQUENCES):
        at = 0
        while at < SEQUENCE:
            own = by_label[r.randint(len(by_label))]
            begin = own[r.randint(len(own))]
            piece = np.arange(begin, min(begin + r.randint(*PIECE), len(label_of), begin + SEQUENCE - at))
            piece = piece[tokens.doc[piece] == tokens.doc[begin]]
            word[row, at : at + len(piece)] = tokens.kind[piece]
            truth[row, at : at + len(piece)] = label_of[begin]
            at += len(piece)
    flat, doc = word.ravel(), np.repeat(np.arange(SEQUENCES), SEQUENCE)
    used = np.bincount(flat, minlength=len(tokens.word)) > 0
    kept = used[owner]
    owner, mark = owner[kept], mark[kept]
    gold = summed(flat, np.eye(n)[truth.ravel()], len(tokens.word))
    gold_steps = np.zeros((n, n))
    np.add.at(gold_steps, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)

    weights, transitions = np.zeros((BUCKETS, n)), np.zeros((n, n))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for t in range(1, steps + 1):
        scores = summed(owner, weights[mark], len(tokens.word))[flat]
        expected = np.zeros((n, n))
        p = marginals(scores, doc, SEQUENCES, transitions, expected)
        slope_words = gold - summed(flat, p, len(tokens.word))
        grad = summed(mark, slope_words[owner], BUCKETS) / SEQUENCES - 1e-4 * weights
        step_grad = (gold_steps - expected) / SEQUENCES - 1e-3 * transitions
        for x, g, m, v in ((weights, grad, *moments[:2]), (transitions, step_grad, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(languages, weights, transitions, lexicon)


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled documents that are not held out."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    ).select("doc_id", "lang", "text")
    # Ids first, so that no task sends more texts than are wanted.
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = known.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text")
    rows = texts.limit(sample).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, part in chunks(texts):
                lettered = np.array([bool(t and _LETTER.search(t)) for t in texts[at : at + len(part)]])
                names, score = [UNKNOWN] * len(part), np.zeros(len(part))
                if model is not None:
                    mean = model.label(Tokens(part), len(part))
                    best = mean.argmax(axis=1)
                    score = np.where(lettered, np.clip(mean[np.arange(len(part)), best], 0, 1), 0)
                    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                part_rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [part_rows.column(0), part_rows.column(1), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
