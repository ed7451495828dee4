"""Quality classifier from trusted positives and unlabelled text.

Only texts known to be good (label 1) and texts of any kind are used, never label 0.

* A text is a vector: its whole-text statistics, each cut at quantiles of the training
  texts, one indicator for each cut it lies above, so that the model is additive in
  step functions of the statistics.
* The class prior, the share of good texts among the unlabelled, is estimated on one half
  of the sample with a classifier of positives against unlabelled fitted on the other: of
  all thresholds the one where (share of unlabelled above) / (share of positives above)
  has the smallest upper confidence bound gives the prior.
* The classifier minimises the non-negative risk estimate: with prior ``w``, logistic loss
  ``l``, positives P and unlabelled U it is ``w E_P l(z) + max(0, E_U l(-z) - w E_P l(-z))``.
  While the second part is negative, the step undoes the overfitting that made it so; as
  the steps then go back and forth, the mean of the second half of them is the result.

Training sees at most ``SAMPLE`` positive and ``SAMPLE`` unlabelled documents that are not
held out, those with the smallest hash of their id, whatever the size of the tables; one row
of statistics for each reaches the driver. Everything else covers all rows.

Labels that are null or have a null id are left out; of several labels of one document the
smallest counts, and of several texts with one id the smallest statistics. Without positives
there is no model: every score is 0.5. Null texts are empty texts; these are scored as any
other. Every input row gives one result row, equal texts get equal scores, and no rows give
none. Texts are read in chunks, whole. Only ``doc_id`` and ``text`` are read of the
documents, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.llm.arrays import chunks
from ledgertree.llm.quality_rules import FEATURES, statistics

#: Most positive, and most unlabelled, documents that train the model.
SAMPLE = 8_000
CUTS = 24
KEEP_AT = 0.7


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """``cuts``: a row of increasing cuts for each statistic; ``weight``: one for each cut."""

    cuts: list[np.ndarray]
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability that a text with these statistics is good."""
        total, at = np.full(len(rows), self.bias), 0
        for column, cuts in zip(rows.T, self.cuts, strict=True):
            # All cuts below the value count: a running sum of their weights.
            steps = np.concatenate(([0.0], np.cumsum(self.weight[at : at + len(cuts)])))
            total += steps[np.searchsorted(cuts, column, side="left")]
            at += len(cuts)
        return _sigmoid(total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quantile_cuts(rows: np.ndarray, count: int = CUTS) -> list[np.ndarray]:
    shares = np.concatenate(([0.002, 0.01], np.linspace(0, 1, count + 1)[1:-1], [0.99, 0.998]))
    return [np.unique(np.quantile(column, shares, method="lower")) for column in rows.T]


def indicators(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([rows[:, k, None] > c for k, c in enumerate(cuts)], axis=1).astype(np.float32)


def non_negative_risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of the positives and the risk of the negatives, the latter not yet cut off at 0."""
    as_negative = np.logaddexp(0, z_unlabelled).mean() - prior * np.logaddexp(0, z_positive).mean()
    return prior * float(np.logaddexp(0, -z_positive).mean()), float(as_negative)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, slopes, steps: int, rate: float, ridge: float):
    """Weights and bias by Adam, the mean of the last half of its steps.

    ``slopes`` gives the loss's slopes at the margins of both samples.
    """
    both = np.concatenate((positive, unlabelled))
    at = len(positive)
    weight = np.zeros(both.shape[1] + 1, dtype=np.float64)
    mean, square, total = (np.zeros_like(weight) for _ in range(3))
    for step in range(1, steps + 1):
        z = both @ weight[:-1].astype(np.float32) + weight[-1]
        slope = np.concatenate(slopes(z[:at], z[at:])).astype(np.float32)
        gradient = np.append(slope @ both, slope.sum()).astype(np.float64)
        gradient[:-1] += ridge * weight[:-1]
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        weight -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        if 2 * step > steps:
            total += weight
    weight = total / (steps - steps // 2)
    return weight[:-1], float(weight[-1])


def against_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 1e-4):
    """Weights and bias of plain logistic regression of positives against unlabelled."""

    def slopes(zp: np.ndarray, zu: np.ndarray):
        return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)

    return _descend(positive, unlabelled, slopes, steps, rate, ridge)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, certainty: float = 0.9) -> float:
    """Share of positives among the unlabelled, from scores of positives against unlabelled.

    Above any threshold the unlabelled hold at least the prior times the positives' share
    there, so each threshold bounds the prior; where no negatives score, the bound is tight.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    doubt = sum(np.sqrt(np.log(4 / (1 - certainty)) / (2 * n)) for n in (len(p), len(u)))
    best = np.argmin(share_u / share_p + doubt / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 1.0))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.03, ridge: float = 1e-3) -> Model | None:
    """Train on rows of statistics; None without positives or without unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return None
    cuts = quantile_cuts(np.concatenate((positive, unlabelled)))
    p, u = indicators(positive, cuts), indicators(unlabelled, cuts)
    weight, bias = against_unlabelled(p[::2], u[::2])
    held = [x[1::2] if len(x) > 1 else x for x in (p, u)]
    prior = estimate_prior(*(x @ weight + bias for x in held))

    def slopes(zp: np.ndarray, zu: np.ndarray):
        _, negative = non_negative_risk(zp, zu, prior)
        of_positive, of_unlabelled = -prior * _sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)
        as_negative = -prior * _sigmoid(zp) / len(zp)
        if negative < 0:
            return -as_negative, -of_unlabelled
        return of_positive + as_negative, of_unlabelled

    weight, bias = _descend(p, u, slopes, steps, rate, ridge)
    return Model(cuts, weight, bias, prior)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the positive and of the unlabelled sample."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    order = (F.xxhash64("doc_id"), "doc_id")
    marked = labels.filter("quality is not null and doc_id is not null").filter(~held_out())
    good = marked.groupBy("doc_id").agg(F.min("quality").alias("label")).filter("label = 1").select("doc_id")
    # Labels without a document take no place in the sample.
    good = good.join(known.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(sample)
    any_ = known.select("doc_id").distinct().orderBy(*order).limit(sample)
    chosen = good.withColumn("good", F.lit(True)).unionByName(any_.withColumn("good", F.lit(False)))
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2).to_pylist()):
                part = batch.slice(at, len(texts))
                columns = [pa.array(c) for c in statistics(texts)[1].T]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "good", *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(work, f"doc_id {kind}, good boolean, " + ", ".join(f"{name} double" for name in FEATURES))
    # One row for each id and sample, so the driver gets at most twice the sample.
    one = found.groupBy("doc_id", "good").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "good", "x.*")
    table = one.toPandas().sort_values("doc_id", kind="stable")
    table["good"] = table["good"].astype(bool)
    return tuple(part[list(FEATURES)].to_numpy(dtype=float) for part in (table[table["good"]], table[~table["good"]]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    return fit(*training_sample(docs, labels, sample))


def scored(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text is an input."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    names = ["doc_id", "held_out", "score", "predicted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2).to_pylist()):
                score = np.full(len(texts), 0.5) if model is None else model.score(statistics(texts)[1])
                part = batch.slice(at, len(texts))
                predicted = pa.array((score >= keep_at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), predicted], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
