"""Alignment of the tokens that two tokenizers cut the same text into.

A token covers a stretch of bytes. Each token points to the farthest-right token of the
other tokenizer that overlaps it; the one that ends where its partner ends points to
itself. Successors of all tokens of a batch are doubled (``next = next[next]``) until
nothing changes, which takes the logarithm of the longest chain: every token then points
to the last token of its component. Components are the groups between byte offsets where
tokens of both end. A group's two last tokens end together: they are its link.

How often a pair of ids is linked anywhere is counted in two steps. Texts are dealt in
blocks (one Arrow batch each, or one very long text); a block lists its distinct pairs once
with their number, and a text's links are indices into that list. The lists are added up
over all blocks, joined back by pair and handed to their block. So a pair that is linked in
every text has one row for each block, no pair has a group of its own, and what a task
holds is one block. Nothing is broadcast but the vocabulary files.

Texts that are null, empty, or whose tokens do not spell the text (the piece model folds
some characters) have no tokens and no links. Texts above ``SEGMENT`` characters are
tokenized in segments, cut at single spaces between two other characters, over which
neither vocabulary merges; results are those of the whole. Every input row gives one result
row, whatever its id; repeated rows count each. No rows give none. Of the input only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgertree.llm.arrays import chunks
from ledgertree.session import materialize

#: Characters of a text tokenized at once.
SEGMENT = 1 << 18

# Classes of these code points are the same in every version of Unicode, so the two
# libraries for the byte-level vocabulary cut such texts alike.
_NOT_LATIN = re.compile("[^\x00-ɏ]")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Parts of about ``size`` characters or more that single spaces join to ``text``."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _LONE_SPACE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def _plain_bytes() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Byte-level BPE of a space and a text, special tokens as plain text.

    ``ranks``, the same vocabulary as a list of ranks, is optional: texts of Latin letters
    then go through the faster library.
    """

    def __init__(self, data: bytes, ranks: bytes | None = None, pattern: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.library = tokenizers.Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True
        plain = _plain_bytes()
        added = {x["content"]: x["content"].encode() for x in json.loads(data).get("added_tokens", [])}
        vocabulary = self.library.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = added[token] if token in added else bytes(map(plain.__getitem__, token))
        self.fast = None
        if ranks is not None:
            split = (line.split() for line in ranks.splitlines() if line)
            merges = {base64.b64decode(token): int(rank) for token, rank in split}
            self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for part in segments(text):
            if self.fast is not None and not _NOT_LATIN.search(part):
                parts.append(self.fast.encode_to_numpy(" " + part, disallowed_special=()))
            else:
                parts.append(np.array(self.library.encode(" " + part, add_special_tokens=False).ids, dtype=np.uint32))
        return np.concatenate(parts)


class Pieces:
    """A piece model that puts a space before the text; unknown characters become bytes."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = []
        self.joined = False  # whether a piece has a space after another character
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece) if self.library.is_byte(i) else None
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
            self.joined |= "▁" in piece.lstrip("▁")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [[text] if self.joined else segments(text) for text in texts]
        ids = self.library.encode([x for own in parts for x in own], num_threads=1)
        arrays = [np.array(x, dtype=np.uint32) for x in ids]
        out, at = [], 0
        for own in parts:
            out.append(np.concatenate(arrays[at : at + len(own)]))
            at += len(own)
        return out


@dataclass(frozen=True)
class Vocabularies:
    """The files of both tokenizers, as bytes, so that tasks need no path."""

    byte_level: bytes
    pieces: bytes
    ranks: bytes | None = None
    pattern: str = ""

    @staticmethod
    def read(byte_level: str, pieces: str, ranks: str | None = None, pattern: str = "") -> Vocabularies:
        parts = []
        for path in (byte_level, pieces, ranks):
            if path is None:
                parts.append(None)
                continue
            with open(path, "rb") as file:
                parts.append(file.read())
        return Vocabularies(*parts, pattern=pattern)


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label of each token of A and of B: the B token that ends its group.

    ``a_end`` and ``b_end`` are the byte ends of two tilings of the same bytes without
    empty tokens.
    """
    a_start, b_start = (np.concatenate(([0], ends[:-1])) for ends in (a_end, b_end))
    from_a = len(a_end) + np.searchsorted(b_start, a_end, side="left") - 1
    from_b = np.searchsorted(a_start, b_end, side="left") - 1
    last = a_end[from_b] == b_end
    from_b[last] = len(a_end) + np.flatnonzero(last)
    successor = np.concatenate((from_a, from_b))
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    label = successor - len(a_end)
    return label[: len(a_end)], label[len(a_end) :]


class Aligner:
    """Both tokenizers, made once in a worker."""

    SEPARATORS = (",", "|", ";", "")

    def __init__(self, files: Vocabularies):
        self.a = ByteLevel(files.byte_level, files.ranks, files.pattern)
        self.b = Pieces(files.pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b))
        # Text of an id with what follows it: four entries for each id.
        ids = range(max(len(self.a.bytes_of), len(self.b.bytes_of)))
        self.text = [f"{i}{s}" for i in ids for s in self.SEPARATORS]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B; both empty where one does not spell the text."""
        none = np.zeros(0, dtype=np.uint32)
        all_a, all_b = [self.a.encode(x) if x else none for x in texts], self.b.encode(texts)
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            spelt = (b"".join(map(t.bytes_of.__getitem__, ids[k].tolist())) for t, ids in ((self.a, all_a), (self.b, all_b)))
            if not text or any(x != whole for x in spelt):
                all_a[k] = all_b[k] = none
        return all_a, all_b

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Tokens of A, of B and groups of each text, its groups as text, and all links in order.

        The text lists each group's ids, ``a1,a2|b1;a3|b2,b3``. A link is
        ``a * (size of B) + b``.
        """
        all_a, all_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (all_a, all_b))
        a, b = (np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64) for ids in (all_a, all_b))
        if not len(a):
            return n_a, n_b, np.zeros(len(texts), np.int64), [""] * len(texts), np.zeros(0, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_label, b_label = components(a_end, b_end)
        last_b = np.flatnonzero(b_label == np.arange(len(b)))
        last_a = np.searchsorted(a_end, b_end[last_b])
        a_group, b_group = np.searchsorted(last_b, a_label), np.searchsorted(last_b, b_label)
        n_groups = np.diff(np.searchsorted(last_b, np.concatenate(([0], np.cumsum(n_b)))))

        # Ids in the order of the text: a group's A tokens, then its B tokens.
        a_at = np.arange(len(a)) + np.where(a_group > 0, last_b[a_group - 1] + 1, 0)
        b_at = np.arange(len(b)) + last_a[b_group] + 1
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[a_at], codes[b_at] = 4 * a, 4 * b
        codes[a_at[last_a]] += 1
        codes[b_at[last_b]] += 2
        ends = np.cumsum(n_a + n_b)
        codes[ends[n_a > 0] - 1] += 1  # nothing follows a text's last id
        shown = list(map(self.text.__getitem__, codes.tolist()))
        groups = ["".join(shown[e - n : e]) for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
        return n_a, n_b, n_groups, groups, a[last_a] * len(self.b.bytes_of) + b[last_b]


_ready: list = []


def _aligner(files: Vocabularies) -> Aligner:
    if not _ready or _ready[0] is not files:
        _ready[:] = [files, Aligner(files)]
    return _ready[1]


def index_type(distinct: int) -> str:
    """Type of the indices into a block's list of pairs."""
    return "<u2" if distinct <= 1 << 16 else "<u4"


def align(docs: DataFrame, files: Vocabularies) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, block, links, pairs, times) of every row.

    ``groups`` lists the ids of each group. ``links`` are indices into the block's
    distinct ``pairs``, which, with the ``times`` each is linked in the block, stand in the
    block's first row only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select("doc_id", "text")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "block", "links", "pairs", "times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            parts, all_links = [], []
            for _, texts in chunks(batch.column(1).to_pylist()):
                *found, links = aligner.align([x.decode() for x in texts])
                parts.append(found)
                all_links.append(links)
            if not parts:
                continue
            pairs, at, times = np.unique(np.concatenate(all_links), return_inverse=True, return_counts=True)
            n_a, n_b, n_groups = (np.concatenate([p[k] for p in parts]) for k in range(3))
            ends = np.cumsum(n_groups)
            at = at.astype(index_type(len(pairs)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *map(pa.array, (n_a, n_b, n_groups)),
                    pa.array([x for p in parts for x in p[3]], pa.string()),
                    pa.array(np.full(batch.num_rows, first + number)),
                    pa.array([at[e - n : e].tobytes() for e, n in zip(ends.tolist(), n_groups.tolist(), strict=True)], pa.binary()),
                    *(pa.array([x] + [None] * (batch.num_rows - 1), pa.list_(pa.int64())) for x in (pairs, times)),
                ],
                names,
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        work,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, block long, links binary,"
        " pairs array<bigint>, times array<bigint>",
    )


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair, and whether no other pair of its B id has more.

    A B id meets at most as many pairs as A has ids, so the window's groups are bounded.
    """
    own = aligned.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = own.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    by_b = counts.withColumn("b", F.col("pair") % b_size)
    return by_b.selectExpr("pair", "n", "n = max(n) over (partition by b) as best")


def with_link_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in place of its block columns."""
    aligned = materialize(aligned, "aligned")
    own = aligned.filter("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    back = own.join(pair_counts(aligned, b_size), "pair").select(F.col("block").alias("of"), "at", "n", "best")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    passed = [c for c in kept if c not in ("block", "links")]

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("at").to_numpy())
        n = known.column("n").to_numpy()[order]
        best = known.column("best").to_numpy()[order]
        kind = index_type(len(order))
        out = np.zeros((3, texts.num_rows), dtype=np.int64)
        for k, data in enumerate(texts.column("links").to_pylist()):
            at = np.frombuffer(data, kind)
            out[:, k] = len(at), best[at].sum(), n[at].sum()
        table = texts.select(passed)
        for name, column in zip(("n_links", "n_best", "count_sum"), out, strict=True):
            table = table.append_column(name, pa.array(column))
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in passed)
    grouped = aligned.select(*kept).groupBy("block").cogroup(back.groupBy("of"))
    return grouped.applyInArrow(work, f"{fields}, n_links long, n_best long, count_sum long")
