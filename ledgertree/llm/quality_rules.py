"""Quality rules: boosted trees over document statistics, flattened for vectorised scoring.

A document's statistics come from its whole text (``FEATURES``). Fixed base rules reject
first: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT_PERCENT`` percent of the words
in repeated windows. The rest is judged by gradient-boosted trees, trained with logistic
loss on labelled rows; the score may never rise with the features in ``FALLING``. Trees
are complete binary trees in numpy arrays, so a batch is scored level by level for all
trees at once.

The training sample is at most ``SAMPLE`` labelled documents, those with the smallest
hash of their id, whatever the size of the labels; only their statistics reach the driver.
Labels that are null or other than 0 and 1 are left out; of several labels of one document
the smallest counts. Without both labels in the sample there is no model and only the base
rules hold. Null and empty texts have no words and fail them. Every input row gives one
result row; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgertree.llm.arrays import U64, Words, chunks, mix, ngrams, spans

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SAMPLE = 8_000
KEEP_AT = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "shouts_per_word", "distinct_share", "top_word_share", "digit_share", "words_per_line",
)
#: The score may not rise with these.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "shouts_per_word")

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))


def _repeated(key: np.ndarray) -> np.ndarray:
    """Marks keys that come more than once."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Marks keys that came before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of ``COUNTS`` and the matrix of ``FEATURES``, a row for each text."""
    w = Words(texts)
    n, docs = len(texts), np.arange(len(texts))
    n_words = w.counts()
    in_word = ~w.space
    chars = w.per_text(in_word & ((w.buf & 0xC0) != 0x80))
    symbols = w.per_text(_SYMBOL[w.buf])

    breaks = np.flatnonzero(w.buf == 10)
    line_start = np.concatenate(([0], breaks[:-1] + 1))
    line_doc = np.searchsorted(w.first, line_start, side="right") - 1
    filled = np.searchsorted(w.start, breaks) > np.searchsorted(w.start, line_start)
    line_start, line_end, line_doc = line_start[filled], breaks[filled], line_doc[filled]
    line_key = mix(spans(w.run, line_start, line_end) + mix(line_doc.astype(U64)))
    dup_lines = np.bincount(line_doc[_later(line_key)], minlength=n)
    n_lines = np.bincount(line_doc, minlength=n)

    salt = mix(docs.astype(U64))[w.doc]
    window = ngrams(w.hash, WINDOW)
    size = len(window)
    inside = np.flatnonzero(w.doc[:size] == w.doc[WINDOW - 1 :]) if size else np.zeros(0, np.int64)
    twice = inside[_repeated(mix(window[inside] + salt[inside]))]
    cover = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeat = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    key = mix(w.hash + salt)
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else order
    times = np.diff(np.append(head, len(key)))
    owner = w.doc[order[head]]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, times)

    counts = dict(zip(COUNTS, (n_words, chars, symbols, dup_lines, repeat), strict=True))
    some, letters, lines = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = np.column_stack(
        (
            np.log1p(n_words), chars / some, symbols / some, dup_lines / lines, repeat / some,
            w.per_text(_UPPER[w.buf]) / letters, w.per_text(w.buf == 33) / some, distinct / some,
            top / some, w.per_text(_DIGIT[w.buf]) / letters, n_words / lines,
        )
    )
    return counts, features


@dataclass
class Trees:
    """``feature``, ``cut`` and ``value``: one row per tree, one column per node, children at 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        trees = np.arange(len(self.feature))
        out = np.empty(len(rows))
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                right = part[line, self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            total = self.bias + self.value[trees, node].sum(axis=1)
            out[at : at + 4096] = 1 / (1 + np.exp(-total))
        return out


def fit(
    rows: np.ndarray,
    good: np.ndarray,
    falling: tuple[str, ...] = FALLING,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 2.0,
) -> Trees | None:
    """Train on feature rows and 0/1 labels; None without both labels."""
    if len(rows) == 0 or good.min() == good.max():
        return None
    width = rows.shape[1]
    sign = np.array([-1 if name in falling else 0 for name in FEATURES])
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)])
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    out = Trees(
        np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), depth,
        float(np.log(good.mean() / (1 - good.mean()))),
    )
    margin = np.full(len(rows), out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = good - p, np.maximum(p * (1 - p), 1e-9)
        members: dict[int, np.ndarray] = {0: np.arange(len(rows))}
        bounds = {0: (-4.0, 4.0)}
        for node in range(inner):
            own, (low, high) = members[node], bounds[node]
            worth = lambda g, h: np.clip(g / (h + ridge), low, high)  # noqa: E731, B023
            gain_of = lambda g, h, v: g * v - 0.5 * (h + ridge) * v * v
            g_all, h_all = slope[own].sum(), curve[own].sum()
            base = gain_of(g_all, h_all, worth(g_all, h_all))
            best = (1e-6, -1, 0)
            for f in range(width):
                cuts = len(edges[f])
                if not cuts or len(own) < 20:
                    continue
                g = np.cumsum(np.bincount(binned[own, f], slope[own], cuts + 1))[:-1]
                h = np.cumsum(np.bincount(binned[own, f], curve[own], cuts + 1))[:-1]
                left, right = worth(g, h), worth(g_all - g, h_all - h)
                gain = gain_of(g, h, left) + gain_of(g_all - g, h_all - h, right) - base
                gain[(h < 1e-3) | (h_all - h < 1e-3) | (sign[f] * (right - left) < 0)] = 0
                pick = int(np.argmax(gain))
                if gain[pick] > best[0]:
                    best = (float(gain[pick]), f, pick)
            _, f, pick = best
            if f < 0:  # every row goes left from here on
                members[2 * node + 1], members[2 * node + 2] = own, own[:0]
                bounds[2 * node + 1] = bounds[2 * node + 2] = (low, high)
                continue
            out.feature[t, node], out.cut[t, node] = f, edges[f][pick]
            goes_right = binned[own, f] > pick
            members[2 * node + 1], members[2 * node + 2] = own[~goes_right], own[goes_right]
            values = [float(worth(slope[m].sum(), curve[m].sum())) for m in (own[~goes_right], own[goes_right])]
            middle = sum(values) / 2
            bounds[2 * node + 1] = (middle, high) if sign[f] < 0 else (low, high)
            bounds[2 * node + 2] = (low, middle) if sign[f] < 0 else (low, high)
        for node in range(inner, nodes):
            own, (low, high) = members[node], bounds[node]
            out.value[t, node] = rate * np.clip(slope[own].sum() / (curve[own].sum() + ridge), low, high)
            margin[own] += out.value[t, node]
    return out


def judge(texts: list[bytes], model: Trees | None, keep_at: float = KEEP_AT) -> dict[str, np.ndarray]:
    """Counts, ``base_failed``, ``score`` and ``kept`` of each text."""
    counts, rows = statistics(texts)
    failed = (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
    )
    score = np.ones(len(texts)) if model is None else model.score(rows)
    return counts | {"base_failed": failed, "score": score, "kept": ~failed & (score >= keep_at)}


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the training sample."""
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                part = batch.slice(at, len(texts))
                features = statistics(texts)[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(c) for c in features.T)], ["doc_id", "label", *FEATURES]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label int, " + ", ".join(f"{name} double" for name in FEATURES)
    # Rows in an order of their own, so that reruns train the same model.
    found = rows.mapInArrow(work, schema).toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return found[list(FEATURES)].to_numpy(dtype=float), found["label"].to_numpy(dtype=float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    return fit(*labelled_statistics(docs, labels, sample))


def judged(docs: DataFrame, model: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, counts, base_failed, kept, score) of every document."""
    rows = docs.select("doc_id", "text")
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                found = judge(texts, model, keep_at)
                columns = [pa.array(found[name]) for name in names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(work, schema + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    at_text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(at_text).to_pylist()):
                kept = judge(texts, model, keep_at)["kept"]
                yield batch.slice(at, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(work, docs.schema)
