"""Periodic runs of words: maximal stretches that repeat a shorter stretch.

A run is a stretch of consecutive words of one text with smallest period ``q``, at least
``max(LEAST, 2 * q)`` words long, that no neighbouring word extends with that period.

Every period ``p`` lays a grid of positions ``0, p, 2p, ...`` over the words; a run of
period ``p`` covers two neighbouring grid points, and the common extensions of the two to
both sides are its ends. All grids together have about n ln n pairs. Extensions come from
:class:`Extensions`: only suffixes at positions of a difference cover (6 of 31 residues)
are sorted; two positions are compared word by word until both reach the cover, which
takes at most 30 words, and from there the smallest entry between their ranks in the table
of common prefixes is read off a sparse table. The longest stretch is found at its smallest
period and at multiples; the smallest is kept.

Words are runs of bytes other than 0x20 and 0x09-0x0D, compared exactly. Work and memory of
a text grow with n log n of its words and pairs are made in blocks, so a very long text costs
memory for its own words only; texts are handled in chunks and never split. Null and empty
texts have no words and no runs. Every input row gives one result row, whatever its id;
equal texts get equal results, and no rows give none. Only ``doc_id`` and ``text`` are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgertree.llm.arrays import chunks

#: Fewest words of a run.
LEAST = 12
#: Difference cover: every difference modulo ``MODULUS`` is one of two members' difference.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Pairs of grid points looked at together.
BLOCK = 1 << 20


def _synchronised() -> np.ndarray:
    """Steps from residues (i, j) until both are in the cover."""
    member = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    step = np.arange(MODULUS)
    both = member[step[:, None] + step]  # residue, step
    return (both[:, None, :] & both[None, :, :]).argmax(axis=2)


_STEPS = _synchronised()


class Extensions:
    """Longest common extension to the right of any two positions of ``ids`` (all positive)."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.words = np.concatenate((ids.astype(np.uint32), np.zeros(MODULUS + 1, np.uint32)))
        # Samples by residue, so that the one a block further on is the next in the list.
        at = np.arange(n + 1)
        at = at[np.isin(at % MODULUS, COVER)]
        at = at[np.argsort(at % MODULUS, kind="stable")]
        self.at = at
        following = np.append(np.arange(1, len(at)), -1)
        following[:-1][at[1:] != at[:-1] + MODULUS] = -1
        levels = self._levels(at, following)
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.full(n + 1, -1, dtype=np.int32)
        self.rank[at[order]] = np.arange(len(at))
        self.table = self._minima(self._neighbours(order, levels))

    def _levels(self, at: np.ndarray, following: np.ndarray) -> list[np.ndarray]:
        """Ranks of the samples by their first block, first two, four, ... until all differ.

        A block that reaches the end of the words is unlike any other, so what follows it
        never counts.
        """
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[at]
        order = np.argsort(blocks.astype(">u4").view(f"S{4 * MODULUS}").ravel(), kind="stable")
        new = np.ones(len(at), dtype=bool)
        for low in range(1, len(at), BLOCK):  # bounded copies of the rows
            high = min(low + BLOCK, len(at))
            new[low:high] = (blocks[order[low:high]] != blocks[order[low - 1 : high - 1]]).any(axis=1)
        self.following = [following]
        levels = [self._ranks(order, new)]
        while levels[-1].max(initial=-1) < len(at) - 1:
            rank, jump = levels[-1], self.following[-1]
            key = rank.astype(np.int64) * (len(at) + 1) + np.where(jump < 0, 0, rank[jump] + 1)
            order = np.argsort(key, kind="stable")
            levels.append(self._ranks(order, np.concatenate(([True], key[order][1:] != key[order][:-1]))))
            self.following.append(np.where(jump < 0, -1, jump[jump]))
        return levels

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.cumsum(new) - 1
        return out

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sample, in sorted order, with the one before it."""
        out = np.zeros(len(order), dtype=np.int32)
        left, right = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(left), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[k][left] == levels[k][right])
            length[same] += MODULUS << k
            left[same], right[same] = self.following[k][left[same]], self.following[k][right[same]]
        left, right = self.at[left], self.at[right]
        live = np.arange(len(left))
        for k in range(MODULUS):
            live = live[self.words[left[live] + k] == self.words[right[live] + k]]
            if not len(live):
                break
            length[live] += 1
        out[1:] = length
        return out

    @staticmethod
    def _minima(row: np.ndarray) -> list[np.ndarray]:
        table, width = [row], 1
        while 2 * width <= len(row):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the positions ``i`` and ``j`` have in common from there on; ``i < j``."""
        out = np.zeros(len(i), dtype=np.int64)
        steps = _STEPS[i % MODULUS, j % MODULUS]
        live = np.arange(len(i))
        for k in range(MODULUS):
            met = live[steps[live] == k]
            if len(met):
                out[met] = k + self._sampled(i[met] + k, j[met] + k)
                live = live[steps[live] > k]
            same = self.words[i[live] + k] == self.words[j[live] + k]
            out[live[~same]] = k
            live = live[same]
            if not len(live):
                break
        return out


def _grids(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all pairs of neighbouring grid points, in blocks."""
    period = np.arange(1, most + 1)
    count = np.maximum((n - 1) // period, 0)
    ends = np.cumsum(count)
    low = 0
    while low < most:
        base = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, base + BLOCK, side="right")), low + 1)
        p, c = np.repeat(period[low:high], count[low:high]), count[low:high]
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        for at in range(0, len(p), BLOCK):  # a single period may have more pairs than a block
            yield k[at : at + BLOCK] * p[at : at + BLOCK], p[at : at + BLOCK]
        low = high


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ``ids`` holds the words of one or more texts, those of different texts being different
    numbers, so that no run crosses texts; the longest text has ``longest`` words.
    """
    n, most = len(ids), longest // 2
    found: list[np.ndarray] = [np.zeros((3, 0), dtype=np.int64)]
    if longest >= least:
        right, left = Extensions(ids), Extensions(ids[::-1])
        for i, p in _grids(n, most):
            same = ids[i] == ids[i + p]
            i, p = i[same], p[same]
            back = left(n - i - p, n - i)
            first = back < p  # of the run's grid points, only the first
            i, p, back = i[first], p[first], back[first]
            length = p + back + right(i, i + p)
            whole = length >= np.maximum(least, 2 * p)
            found.append(np.stack((i - back, length, p))[:, whole])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def scan(texts: list[bytes], least: int = LEAST):
    """Word counts, (text, start, length, period) of the runs, and each text without repeats."""
    words = [text.split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), dtype=np.uint32)
    used = 0
    for at, own in zip(first.tolist(), words, strict=True):
        number = {word: k for k, word in enumerate(dict.fromkeys(own), used + 1)}
        ids[at : at + len(own)] = np.fromiter(map(number.__getitem__, own), np.uint32, len(own))
        used += len(number)
    start, length, period = find_runs(ids, int(sizes.max(initial=0)), least)
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step[:-1]) == 0
    # Texts without words share their first position with the next; the last of them owns it.
    text = np.searchsorted(first, start, side="right") - 1
    cut = set(text.tolist())
    left = [
        b" ".join([w for w, k in zip(own, kept[at : at + len(own)].tolist(), strict=True) if k] if i in cut else own)
        for i, (at, own) in enumerate(zip(first.tolist(), words, strict=True))
    ]
    return sizes, (text, start - first[text], length, period), left


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` is an array of (start, length, period) in words, by start and period;
    ``collapsed`` is the words that no run repeats, joined by spaces.
    """
    rows = docs.select("doc_id", "text")
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                sizes, (text, start, length, period), left = scan(texts, least)
                edges = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (start, length, period)]
                runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(edges), runs),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<{run}>, collapsed string")
