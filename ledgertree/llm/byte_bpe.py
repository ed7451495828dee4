"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one is a minimal perfect
hash over the vocabulary: hash and displace, one slot per token, no empty slot. A
pre-token that is a token itself is resolved there. Tier two takes the misses: a heap of
adjacent pairs over a doubly linked list of bytes, lowest rank first, leftmost on ties.

``encode`` gives each text's ids as little-endian unsigned 32-bit integers in one binary
value, ``decode`` the bytes again. Null texts count as empty (no ids). Rows repeat as
often as they come; extra columns of the input are not read. An empty table stays empty.

The vocabulary is read on the driver, so its size (at most ``MAX_TOKENS``) bounds what is
broadcast. Each Python worker keeps at most ``CACHE`` resolved pre-tokens, namely those
that it has met in more than one batch.

Letters and numbers are those of the Unicode version that the ``regex`` package knows;
code points that another version does not assign yet may be cut differently there.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ledgertree.llm.arrays import U64, fingerprints, mix

MAX_TOKENS = 4_000_000
CACHE = 150_000
#: Places of a table of pre-tokens met once; only those met again are kept.
DOOR = 1 << 22
_PER_BUCKET = 4
_STEP = U64(0x9E3779B97F4A7C15)
#: White space as the pattern's engine defines it (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _scaled(x: np.ndarray, size: int) -> np.ndarray:
    """The upper 32 bits of ``x`` as a number below ``size``."""
    return ((x >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``slot(keys)`` is one to one onto 0..n-1."""

    def __init__(self, keys: np.ndarray):
        self.n = n = len(keys)
        self.buckets = max(1, n // _PER_BUCKET)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        bucket = _scaled(mix(keys), self.buckets)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        end = np.cumsum(size)
        free = np.ones(n, dtype=bool)
        by_size = np.argsort(-size, kind="stable")
        for b in by_size[size[by_size] > 1]:
            own, tries, at = keys[order[end[b] - size[b] : end[b]]], 64, 1
            while True:
                shifts = np.arange(at, at + tries, dtype=U64)
                slots = _scaled(mix(own[None, :] + shifts[:, None] * _STEP), n)
                good = free[slots].all(axis=1)
                if len(own) > 1 and good.any():
                    ranked = np.sort(slots[good], axis=1)
                    distinct = (np.diff(ranked, axis=1) > 0).all(axis=1)
                    good[np.flatnonzero(good)[~distinct]] = False
                if good.any():
                    pick = int(np.argmax(good))
                    self.shift[b] = at + pick
                    free[slots[pick]] = False
                    break
                at, tries = at + tries, min(4096, tries * 2)
        # A bucket of one key takes any slot that is left and stores it.
        singles = by_size[size[by_size] == 1]
        self.shift[singles] = -1 - np.flatnonzero(free)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[_scaled(mix(keys), self.buckets)]
        moved = _scaled(mix(keys + shift.astype(U64) * _STEP), self.n)
        return np.where(shift < 0, -1 - shift, moved)


class Vocabulary:
    """Tokens by rank, with the perfect hash over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_TOKENS:
            raise ValueError(f"a vocabulary of {len(ranks)} tokens; at most {MAX_TOKENS} are broadcast")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        tokens = list(ranks)
        keys = fingerprints(tokens)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens share a 64-bit fingerprint")
        self.hash = PerfectHash(keys)
        self.tokens: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slot(keys).tolist(), strict=True):
            self.tokens[slot] = token
        self.ids = np.array([ranks[t] for t in self.tokens], dtype="<u4")
        self.ranks = ranks
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.pattern = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(
            r"\S", f"[^{_SPACE}]"
        )

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: one base64 token and its rank per line."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def resolve(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token, packed."""
        raw = [piece.encode() for piece in pieces]
        slots = self.hash.slot(fingerprints(raw)).tolist()
        tokens, ids = self.tokens, self.ids
        return [
            ids[slot].tobytes() if tokens[slot] == data else self.merged(data)
            for data, slot in zip(raw, slots, strict=True)
        ]

    def merged(self, data: bytes) -> bytes:
        """Merge the lowest-ranked adjacent pair until none is in the vocabulary."""
        size, rank, pair = len(data), self.ranks.get, self.pairs
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # now[i]: rank of the token at i joined with the next one, -1 if there is none.
        now = [pair[a << 8 | b] for a, b in zip(data, data[1:])]
        now.append(-1)
        shift = size.bit_length()
        places = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            least = pop(heap)
            left = least & places
            if now[left] != least >> shift:
                continue  # one of the two was merged meanwhile
            mid = after[left]
            end = after[mid]
            after[left], now[mid], now[left] = end, -1, -1
            if end < size:
                before[end] = left
                r = rank(data[left : after[end]])
                if r is not None:
                    now[left] = r
                    push(heap, r << shift | left)
            first = before[left]
            if first >= 0:
                r = rank(data[first:end])
                now[first] = -1 if r is None else r
                if r is not None:
                    push(heap, r << shift | first)
        out, at = [], 0
        while at < size:
            out.append(self.ranks[data[at : after[at]]])
            at = after[at]
        return struct.pack(f"<{len(out)}I", *out)


_kept: dict[str, bytes] = {}
_kept_for: list[object] = []
_met = np.zeros(DOOR, dtype=bool)


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> list[bytes]:
    if not _kept_for or _kept_for[0] is not vocabulary:
        _kept.clear()
        _kept_for[:] = [vocabulary]
    find = regex.compile(vocabulary.pattern).findall
    all_pieces = [find(text) if text else [] for text in texts]
    distinct = set().union(*all_pieces)
    new = list(distinct.difference(_kept))
    resolved = vocabulary.resolve(new)
    # A Bloom filter of one hash: a false hit keeps a pre-token early, and no more.
    door = (fingerprints([piece.encode() for piece in new]) % U64(DOOR)).astype(np.int64)
    again = _met[door]
    _met[door] = True
    known = {piece: _kept[piece] for piece in distinct.intersection(_kept)}
    known.update(zip(new, resolved, strict=True))
    out = [b"".join(map(known.__getitem__, pieces)) for pieces in all_pieces]
    if len(_kept) + int(again.sum()) > CACHE:
        _kept.clear()
        _met[:] = False
    _kept.update((piece, ids) for piece, ids, twice in zip(new, resolved, again.tolist(), strict=True) if twice)
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encode_texts(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def by_rank(vocabulary: Vocabulary) -> list[bytes]:
    """The tokens at the places of their ids."""
    table = [b""] * (int(vocabulary.ids.max()) + 1)
    for token, rank in vocabulary.ranks.items():
        table[rank] = token
    return table


def decode_ids(packed: list[bytes | None], table: list[bytes]) -> list[bytes | None]:
    return [
        None if ids is None else b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in packed
    ]


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """The input with a column ``decoded``, the bytes that the ids stand for; null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    at = encoded.columns.index(ids_col)
    kept = [i for i, name in enumerate(encoded.columns) if name != "decoded"]
    fields = [encoded.schema.fields[i] for i in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = []
        for batch in batches:
            table = table or by_rank(shared.value)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = decode_ids(part.column(at).to_pylist(), table)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), pa.array(texts, pa.binary())],
                    [*(f.name for f in fields), "decoded"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.mapInArrow(work, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``decode`` of ``encode``, both done by one Python worker of a task.

    Two steps of Python in one stage take two workers for each task, and each holds the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = []
        for batch in batches:
            table = table or by_rank(shared.value)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encode_texts(part.column(1).to_pylist(), shared.value)
                texts = decode_ids(ids, table)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["id", "ids", "decoded"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)
