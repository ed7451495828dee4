"""Line dedup: an exact set-similarity join of lines.

A line (\\n-split) with words, however few, is the set of its words, A-Z lower-cased.
It is removed when an earlier line, by (doc_id, line number), has a Jaccard similarity of
at least ``PERCENT`` percent; similarity is judged on the input, not on what is left.
Null ids come first. Rows of one id, or of none, are told apart by a hash of their text,
which also orders their lines of one number; rows equal in both get equal results.

Words are ordered by rarity: by their counts in a table of ``COUNTERS`` hashed counters
over all lines, ties by fingerprint. Any fixed order keeps the join exact; rare words first
make it fast, and the table's size is what bounds the broadcast. Equal sets are one class.
A class is indexed under the words of its prefix. Postings are dealt to buckets by word and
move as packed columns, so a bucket is sorted as arrays. Rows of one word come sorted by set
size and meet under the length filter, the index-prefix and positional filters and a bound
from 128 parities of hashed words; surviving pairs are verified on the sets, for which only
the lines of classes in pairs are read from the texts again.

A line goes as soon as one earlier line is like it, so pairs are not listed: a first round
verifies for each class the earlier one that the sketches put nearest. Only classes that
this leaves open and that have met further ones enter a second round, with all their pairs.

Null and empty texts have no lines that count, and lines without words stay. Very long texts
are read whole, in chunks of their own. No rows give none, and columns other than ``doc_id``
and ``text`` may have any name. Word and set identities are 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.llm.arrays import U64, Words, chunks, mix
from ledgertree.llm.registry import free_names, settled

PERCENT = 80
MIN_WORDS = 1
#: Distinct words from which a set can be like another one; smaller ones only have copies.
LEAST_NEAR = -(-PERCENT // (100 - PERCENT))
COUNTERS = 1 << 20
#: Parts of the table of counters that are added up on their own.
SLICES = 64
#: Places at which a task remembers a class, so as to index it once or a few times.
SEEN = 1 << 17
#: Open classes of 8 bytes that are broadcast at most; more are joined.
MAX_BROADCAST = 500_000
#: Postings that a task packs at once, and that a bucket holds on average.
PACK, BUCKET = 1 << 17, 100_000
#: Postings that meet others at once, and pairs that are held at once.
MEET, PAIRS = 1 << 16, 1 << 18
#: Places of a bitmap of lines to read again for each of them, and in all.
SPARSE, MAX_MARKS = 16, 1 << 27


class Lines:
    """Lines of some texts that have words, with their words."""

    def __init__(self, texts: list[bytes], least: int = MIN_WORDS):
        w = Words(texts, lower=True)
        breaks = np.flatnonzero(w.buf == 10)
        start = np.concatenate(([0], breaks[:-1] + 1))
        doc = np.searchsorted(w.first, start, side="right") - 1
        begin = np.searchsorted(w.start, start)
        count = np.searchsorted(w.start, breaks) - begin
        number = np.arange(len(start)) - np.searchsorted(start, w.first)[doc]
        good = count >= least
        self.doc, self.number, self.count = doc[good], number[good], count[good]
        inside = np.zeros(len(w.start) + 1, dtype=np.int64)
        np.add.at(inside, begin[good], 1)
        np.add.at(inside, (begin + count)[good], -1)
        self.token = w.hash[np.cumsum(inside[:-1]) > 0]
        self.line = np.repeat(np.arange(len(self.doc)), self.count)


def counters(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> U64(44)).astype(np.int64) % COUNTERS


def rarity(docs: DataFrame) -> np.ndarray:
    """Hashed counts of the words of all lines; tasks add up the slices of the table."""
    size = COUNTERS // SLICES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0).to_pylist()):
                total += np.bincount(counters(Lines(texts).token), minlength=COUNTERS)
        parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(SLICES, size)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["at", "n"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, np.zeros(size, np.int64)) + np.frombuffer(part, "<i4")
        parts = [np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], ["at", "n"])

    kind = "at int, n binary"
    found = docs.select("text").mapInArrow(work, kind).repartition("at").mapInArrow(add, kind).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int32)
    for at, part in zip(found["at"].to_pylist(), found["n"].to_pylist(), strict=True):
        out[at * size : (at + 1) * size] = np.frombuffer(part, "<i4")
    return out


def marks(keys: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` hashed places, a power of two, with those of the longs in the only column set."""
    width = min(size, 1 << 18)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(marked(batch.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], ["part", "place"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(part).tolist():
                found.setdefault(k, np.zeros(width, bool))[place[part == k]] = True
        bits = [np.packbits(x).tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    dealt = keys.mapInArrow(places, "part int, place int").repartition("part")
    found = dealt.mapInArrow(join, "part int, bits binary").toArrow()
    out = np.zeros(size // 8, dtype=np.uint8)
    for at, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[at * width // 8 : (at + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    return out


def marked(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a bitmap of ``marks``."""
    return (mix(keys.astype(np.int64).view(U64) + U64(9)) & U64(size - 1)).astype(np.int64)


def in_marks(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = marked(keys, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def ordered_sets(lines: Lines, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, words): each line's distinct words, rarest first, one line after another."""
    order = np.lexsort((lines.token, lines.line << 32 | rank[counters(lines.token)]))
    token, line = lines.token[order], lines.line[order]
    if len(token):
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (line[1:] != line[:-1])))
        token, line = token[new], line[new]
    return np.bincount(line, minlength=len(lines.doc)), token


def set_ids(sizes: np.ndarray, token: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token + U64(5)))))
    end = np.cumsum(sizes)
    return mix(run[end] - run[end - sizes] + mix(sizes.astype(U64))).view(np.int64)


def sketches(sizes: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of each set's hashed words; two sets differ in at most as many as in words."""
    if not len(token):
        return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    place = mix(token + U64(3)) >> U64(57)
    bit, first = U64(1) << (place & U64(63)), np.cumsum(sizes) - sizes
    low = place < U64(64)
    halves = (np.where(low, bit, U64(0)), np.where(low, U64(0), bit))
    return tuple(np.bitwise_xor.reduceat(half, first).view(np.int64) for half in halves)


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def index_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shorter prefix that is enough for the smaller set of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


NO_DOC = -(1 << 63)
_LINES = "row long, line_no int, set_id long, n int, bits long, bits2 long, prefix array<int>"


class Leads:
    """Classes that a task has met, with the earliest place of each that it still remembers."""

    def __init__(self):
        self.ids = np.zeros(SEEN, np.int64)
        self.place = [np.full(SEEN, 2**63 - 1, np.int64) for _ in range(3)]

    def lead(self, ids: np.ndarray, *place: np.ndarray) -> np.ndarray:
        """Marks lines that are earlier than all remembered ones of their class."""
        order = np.lexsort((*place[::-1], ids))
        own = ids[order]
        at = order[np.append(True, own[1:] != own[:-1])] if len(own) else order
        slot = (mix(ids[at].view(U64)) & U64(SEEN - 1)).astype(np.int64)
        later, same = np.zeros(len(at), bool), self.ids[slot] == ids[at]
        for old, new in zip(self.place, place, strict=True):
            later |= same & (new[at] > old[slot])
            same &= new[at] == old[slot]
        at, slot = at[~(later | same)], slot[~(later | same)]
        # One class only may take a place.
        slot, one = np.unique(slot, return_index=True)
        self.ids[slot] = ids[at[one]]
        for old, new in zip(self.place, place, strict=True):
            old[slot] = new[at[one]]
        out = np.zeros(len(ids), bool)
        out[at] = True
        return out


def line_table(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, row, line_no, set_id, n, bits, bits2, prefix); the earliest line of a class that a task knows has its prefix.

    A word of a prefix stands as 32 bits of its fingerprint: words that agree in them only meet in vain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text", doc.alias("doc"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = Leads()
        for batch in batches:
            rows_of, docs_of = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for at, texts in chunks(batch.column(2).to_pylist()):
                lines = Lines(texts)
                sizes, token = ordered_sets(lines, shared.value)
                ids = set_ids(sizes, token)
                lead = leads.lead(ids, docs_of[lines.doc + at], lines.number, rows_of[lines.doc + at])
                take = np.where(lead, prefix_size(sizes), 0)
                first = np.cumsum(sizes) - sizes
                spot = np.arange(int(take.sum())) + np.repeat(first - np.cumsum(take) + take, take)
                words = (mix(token[spot]) >> U64(32)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array(words))
                bits = (np.where(lead, x, 0) for x in sketches(sizes, token))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(lines.doc + at)) for k in (0, 1)),
                        pa.array(lines.number, pa.int32()), pa.array(ids),
                        pa.array(sizes, pa.int32()), *map(pa.array, bits), prefix,
                    ],
                    ["doc_id", "row", "line_no", "set_id", "n", "bits", "bits2", "prefix"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return settled(rows.mapInArrow(work, f"doc_id {kind}, {_LINES}"), "lines")


def meet(token, n, ids, doc, line, pos, bits, bits2, asked=None, percent: int = PERCENT) -> Iterator[dict[str, np.ndarray]]:
    """Pairs of classes that pass all filters, as row numbers ``earlier`` and ``later``, and the ``bits`` they differ in.

    Rows are sorted by (token, n, id). ``asked`` marks the rows that may be the later one. Pairs come some at a time.
    """
    out, held = [], 0
    for low in range(0, len(token), MEET):
        at, step = np.arange(low, min(low + MEET, len(token))), 0
        while len(at):
            step += 1
            at = at[at + step < len(token)]
            other = at + step
            near = (token[at] == token[other]) & (100 * n[at] >= percent * n[other])
            at, other = at[near], other[near]
            need = -(-percent * (n[at] + n[other]) // (100 + percent))
            most = np.minimum(n[at] - pos[at], n[other] - pos[other])
            good = (ids[at] != ids[other]) & (pos[at] < index_size(n[at], percent)) & (most >= need)
            a, b, most = at[good], other[good], (n[at] + n[other] - 2 * need)[good]
            apart = sum(np.bitwise_count((x[a] ^ x[b]).view(U64)).astype(np.int64) for x in (bits, bits2))
            good = apart <= most
            a, b, apart = a[good], b[good], apart[good]
            late = (doc[a] > doc[b]) | ((doc[a] == doc[b]) & (line[a] > line[b]))
            early, later = np.where(late, b, a), np.where(late, a, b)
            if asked is not None:
                early, later, apart = early[asked[later]], later[asked[later]], apart[asked[later]]
            if len(early):
                out.append((early, later, apart))
                held += len(early)
            if held >= PAIRS:
                yield dict(zip(("earlier", "later", "bits"), map(np.concatenate, zip(*out, strict=True)), strict=True))
                out, held = [], 0
    if out:
        yield dict(zip(("earlier", "later", "bits"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def nearest(found: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier, later, more): rows of the nearest earlier class of each later one, and whether it has others."""
    order = np.lexsort((ids[found["earlier"]], found["bits"], ids[found["later"]]))
    early, later = found["earlier"][order], found["later"][order]
    own, others = ids[later], ids[early]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    # Equal pairs from several words are one; the last differs from the first if there are others.
    more = np.minimum.reduceat(others, first) != np.maximum.reduceat(others, first)
    return early[first], later[first], more


#: What moves of a posting; ``doc`` less the least one of its pack.
_PACKED = ("token", "n", "set_id", "doc", "line_no", "pos", "bits", "bits2", "asked")


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers of at least 0 in as few bytes as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << (8 * int(k[2]))))


def postings(lines: DataFrame, buckets: int, words: np.ndarray | None = None) -> DataFrame:
    """The words of the prefixes of classes that can be like others, dealt to ``buckets`` by word, many in a row.

    Each column holds as many values as ``count`` says. With ``words``, a bitmap, only those in it.
    """
    shared = None if words is None else lines.sparkSession.sparkContext.broadcast(words)
    asked = F.col("asked") if "asked" in lines.columns else F.lit(True)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc")
    rows = lines.filter(f"size(prefix) > 0 and n >= {LEAST_NEAR}").select(
        "n", "set_id", doc, "line_no", "bits", "bits2", asked.cast("int").alias("asked"), "prefix"
    )

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        names = ("n", "set_id", "doc", "line_no", "bits", "bits2", "asked", "token", "pos")
        own = dict(zip(names, map(np.concatenate, zip(*held, strict=True)), strict=True))
        bucket = narrow(mix(own["token"].astype(U64)) % U64(buckets))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        edges = np.append(first, len(bucket))
        base = int(own["doc"].min())
        own["doc"] = own["doc"].view(U64) - np.array([base]).view(U64)
        columns = []
        for name in _PACKED:
            values = own[name].view(U64) if name in ("set_id", "bits", "bits2") else narrow(own[name])
            buffers = [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values[order])]
            columns.append(pa.Array.from_buffers(pa.binary(), len(first), buffers))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[first].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)),
                pa.array([base] * len(first), pa.int64()), *columns,
            ],
            ["bucket", "count", "base", *_PACKED],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            prefix = batch.column(7)
            token = prefix.flatten().to_numpy().view(np.uint32)
            sizes = prefix.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if shared is not None:
                keep = in_marks(token.view(np.int32), shared.value)
                token, row, pos = token[keep], row[keep], pos[keep]
            if not len(token):
                continue
            held.append([*(batch.column(k).to_numpy()[row] for k in range(7)), token, pos])
            count += len(token)
            if count >= PACK:
                yield packed(held)
                held, count = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(work, "bucket int, count int, base long, " + ", ".join(f"{c} binary" for c in _PACKED))


def unpacked(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The postings of rows of ``postings``, a class once under a word with its earliest place, sorted by (token, n, id)."""
    counts = np.concatenate([b.column(1).to_numpy() for b in batches])
    base = np.repeat(np.concatenate([b.column(2).to_numpy() for b in batches]), counts)
    own = {}
    for k, name in enumerate(_PACKED, start=3):
        values = (x for b in batches for x in b.column(k).to_pylist())
        own[name] = np.concatenate([
            np.frombuffer(x, f"<u{len(x) // c}").astype(U64) for x, c in zip(values, counts.tolist(), strict=True)
        ]).view(np.int64)
    own["doc"] = (own["doc"].view(U64) + base.view(U64)).view(np.int64)
    order = np.lexsort((own["set_id"], own["token"].view(U64) << U64(32) | own["n"].view(U64)))
    own = {name: x[order] for name, x in own.items()}
    token, ids = own["token"], own["set_id"]
    again = (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])
    # Several tasks may give one class.
    if again.any():
        first = np.flatnonzero(np.append(True, ~again))
        doc = np.minimum.reduceat(own["doc"], first)
        here = own["doc"] == np.repeat(doc, np.diff(np.append(first, len(token))))
        line = np.minimum.reduceat(np.where(here, own["line_no"], 2**62), first)
        pos = np.minimum.reduceat(own["pos"], first)
        own = {name: x[first] for name, x in own.items()} | {"doc": doc, "line_no": line, "pos": pos}
    return own


def place_keys(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(doc.view(U64) + U64(21)) + line.astype(U64)).view(np.int64)


def matched(parts: DataFrame, all_pairs: bool) -> DataFrame:
    """(earlier, later, more) of postings that meet; with ``all_pairs`` only for rows that are ``asked``, but all.

    ``earlier_at`` and ``later_at`` are the keys of the places where the classes are first found.
    """

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(held)
        ids, doc, line = own["set_id"], own["doc"], own["line_no"]
        asked = own["asked"].astype(bool) if all_pairs else None
        found = meet(own["token"], own["n"], ids, doc, line, own["pos"], own["bits"], own["bits2"], asked)
        for part in found:
            if all_pairs:
                both = np.column_stack((ids[part["earlier"]], ids[part["later"]]))
                one = np.unique(both, axis=0, return_index=True)[1]
                early, later, more = part["earlier"][one], part["later"][one], np.zeros(len(one), bool)
            else:
                early, later, more = nearest(part, ids)
            at = (place_keys(doc[rows], line[rows]) for rows in (early, later))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (ids[early], ids[later], more, *at)], ["earlier", "later", "more", "earlier_at", "later_at"]
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
            for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=False):
                if held and bucket[low] != last:
                    yield from pairs(held)
                    held = []
                last = bucket[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from pairs(held)

    ordered = parts.repartition("bucket").sortWithinPartitions("bucket")
    found = ordered.mapInArrow(work, "earlier long, later long, more boolean, earlier_at long, later_at long")
    return found.groupBy("earlier", "later").agg(*(F.max(c).alias(c) for c in ("more", "earlier_at", "later_at")))


def word_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, tokens) of the classes in ``pairs``, and of a few more, read from the texts again.

    A bitmap of the classes and their places tells which lines; texts are read where they are and not moved.
    """
    keys = pairs.select(F.explode(F.array("earlier", "later", "earlier_at", "later_at")))
    size = 1 << 20
    while size < min(MAX_MARKS, SPARSE * 4 * pairs.count()):
        size *= 2
    shared = docs.sparkSession.sparkContext.broadcast(marks(keys, size))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of = batch.column(0).to_numpy()
            for at, texts in chunks(batch.column(1).to_pylist()):
                buf = b"\n".join(texts) + b"\n"
                end = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10)
                start = np.append(0, end[:-1] + 1)
                first = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
                doc = np.searchsorted(first, start, side="right") - 1
                number = np.arange(len(start)) - np.searchsorted(start, first)[doc]
                wanted = np.flatnonzero(in_marks(place_keys(docs_of[doc + at], number), shared.value))
                part = [buf[i:j] for i, j in zip(start[wanted].tolist(), end[wanted].tolist(), strict=True)]
                w = Words(part, lower=True)
                order = np.lexsort((w.hash, w.doc))
                token, own = w.hash[order], w.doc[order]
                new = np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1]))[: len(token)]
                token, sizes = token[new], np.bincount(own[new], minlength=len(part))
                ids = set_ids(sizes, token)
                sets = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(token.view(np.int64))
                )
                # Other lines that the bitmap lets through are of other classes.
                kept = (sizes > 0) & in_marks(ids, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids), sets], ["id", "tokens"]).filter(pa.array(kept))

    found = rows.mapInArrow(work, "id long, tokens array<long>")
    # Rows of one id and text give the same lines.
    return settled(found.groupBy("id").agg(F.first("tokens").alias("tokens")), "token-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(later) of the pairs whose similarity reaches the threshold."""
    first = sets.select(F.col("id").alias("earlier"), F.col("tokens").alias("_x"))
    second = sets.select(F.col("id").alias("later"), F.col("tokens").alias("_y"))
    both = pairs.select("earlier", "later").join(first, "earlier").join(second, "later")
    common = F.size(F.array_intersect("_x", "_y"))
    like = both.filter((100 + PERCENT) * common >= PERCENT * (F.size("_x") + F.size("_y")))
    return like.select("later").distinct()


def repeated_classes(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(later): classes whose first line is like an earlier line of another class."""
    spark = docs.sparkSession
    count = lines.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET))
    pairs = settled(matched(postings(lines, buckets), all_pairs=False), "nearest-lines")
    done = settled(verified(pairs, word_sets(docs, pairs)), "repeated-lines")

    met = pairs.groupBy("later").agg(F.max("more").alias("more"), F.count("*").alias("n"))
    open_ = met.filter("more or n > 1").join(done, "later", "left_anti").select(F.col("later").alias("_open"))
    open_ = settled(open_, "open-lines")
    asked = open_.count()
    if not asked:
        return done
    # Only rows under a word of an open class can meet it.
    open_ = F.broadcast(open_) if asked <= MAX_BROADCAST else open_
    same = F.col("set_id") == F.col("_open")
    leads = lines.filter("size(prefix) > 0")
    words = marks(leads.join(open_, same, "left_semi").select(F.explode(F.col("prefix").cast("array<long>"))), MAX_MARKS >> 3)
    rows = leads.join(open_, same, "left").withColumn("asked", F.col("_open").isNotNull())
    more = settled(matched(postings(rows, buckets, words), all_pairs=True), "open-pairs")
    more = settled(more.join(pairs.select("earlier", "later"), ["earlier", "later"], "left_anti"), "open-pairs")
    return done.unionByName(verified(more, word_sets(docs, more))).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no) of every removed line; ``row`` is the hash of its text."""
    lines = line_table(docs, rarity(docs))
    repeated = repeated_classes(docs, lines).select(F.col("later").alias("_later"), F.lit(True).alias("_all"))
    first = lines.filter("size(prefix) > 0").groupBy(F.col("set_id").alias("_id")).agg(
        F.min(F.struct("doc_id", "line_no", "row")).alias("first")
    )
    known = first.join(repeated, F.col("_id") == F.col("_later"), "left").select(
        "_id", "first", F.coalesce("_all", F.lit(False)).alias("_all")
    )
    here = F.struct("doc_id", "line_no", "row")
    marked = lines.select("doc_id", "row", "line_no", "set_id").join(known, F.col("set_id") == F.col("_id"))
    return marked.filter(F.col("_all") | (here > F.col("first"))).select("doc_id", "row", "line_no")


def _with_removed(docs: DataFrame, rows: DataFrame, row: str, name: str) -> DataFrame:
    """``rows`` with the numbers of each row's removed lines in order, NULL where none are.

    ``rows`` has a ``doc_id`` and, as ``row``, the hash of the text for each row of ``docs``.
    """
    doc, text = free_names([*rows.columns, name], "_doc", "_text")
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(text)).agg(
        F.array_sort(F.collect_set("line_no")).alias(name)
    )
    own = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(text))
    return rows.join(gone, own, "left").drop(doc, text)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): one row per row of ``docs``, line numbers from 0 in order."""
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    none = F.array().cast("array<int>")
    # Texts stay where they are; only their hashes move.
    rows = docs.select("doc_id", n_lines.alias("n_lines"), F.xxhash64("text").alias("row"))
    return _with_removed(docs.select("doc_id", "text"), rows, "row", "gone").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone", none).alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines left out of ``text``; all documents stay."""
    row, gone = free_names(docs.columns, "_row", "_gone")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = docs.withColumn(row, F.xxhash64("text"))
    return _with_removed(docs.select("doc_id", "text"), rows, row, gone).withColumn("text", text).select(*docs.columns)
