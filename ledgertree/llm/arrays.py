"""Texts as byte arrays: words, lines and their 64-bit fingerprints without a loop per word.

A batch of texts is joined by line feeds into one byte buffer, so neither a word nor a
line crosses texts. A span's fingerprint is a polynomial over its bytes, taken from one
running sum, and then mixed; equal bytes have equal fingerprints everywhere, as the
constants come from a fixed rule. Words are runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(count: int, seed: int) -> np.ndarray:
    """``count`` numbers that depend on ``seed`` alone."""
    steps = np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(steps + U64(seed))


BASE = int(randoms(1, 11)[0]) | 1
BACK = pow(BASE, -1, 1 << 64)
VALUE = randoms(256, 12)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        size = max(count, CHUNK + 1024)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if count <= 4 * CHUNK:
            _powers[base] = have
    return have[:count]


def sums(buf: np.ndarray) -> np.ndarray:
    """Running sums from which ``spans`` reads; one longer than ``buf``."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(VALUE[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def spans(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of each span [start, end) of the buffer behind ``run``."""
    return mix((run[end] - run[start]) * powers(BACK, len(run))[start] + (end - start).astype(U64))


def fingerprints(items: list[bytes]) -> np.ndarray:
    """Fingerprints of whole byte strings, the same as ``spans`` gives."""
    if not items:
        return np.zeros(0, dtype=U64)
    out = []
    for at in range(0, len(items), 1 << 16):
        part = items[at : at + (1 << 16)]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(sizes)
        out.append(spans(sums(np.frombuffer(b"".join(part), np.uint8)), end - sizes, end))
    return np.concatenate(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` consecutive items, one per start."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    keys = randoms(n, 13 + n) | U64(1)
    out = np.zeros(len(hashes) - n + 1, dtype=U64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * keys[i]
    return mix(out)


class Words:
    """Words of some texts: ``doc`` (index of the text), ``start``, ``end``, ``hash``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[self.buf]
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.space = space
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.doc = np.repeat(np.arange(len(texts)), self.counts())
        self.run = sums(LOWER[self.buf] if lower else self.buf)
        self.hash = spans(self.run, self.start, self.end)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        edges = np.searchsorted(self.start, np.append(self.first, len(self.buf)))
        return np.diff(edges)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of ``marks``, one per byte, over each text."""
        run = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return run[self.first + self.sizes] - run[self.first]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) in runs of about ``CHUNK`` bytes; null is empty."""
    part: list[bytes] = []
    size = at = 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode()
        if part and size + len(data) > CHUNK:
            yield at, part
            part, size, at = [], 0, i
        part.append(data)
        size += len(data) + 1
    if part:
        yield at, part
