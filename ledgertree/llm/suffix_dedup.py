"""Suffix-array dedup by prefix-free parsing: bytes of strings that also start earlier.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier, in a
document with a smaller id or in the same one; documents are UTF-8 bytes, and strings are
judged on the input.

1. Parse. A rolling hash of ``TRIGGER`` bytes is taken at every place; a string's trigger is
   its smallest (leftmost on ties). The text is cut where the trigger changes, and phrases
   overlap by ``LENGTH`` - 1 bytes, so every string lies in exactly one phrase, and equal
   strings have equal triggers in equal places. The parse is the list of phrases.
2. Dictionary. Phrases come together by trigger. Of equal phrases the earliest stays in the
   dictionary; the others' strings all start earlier elsewhere. A phrase whose trigger no
   other dictionary phrase has holds no repeated string.
3. Suffix array. The suffixes of the remaining dictionary phrases that hold a whole string
   are sorted by their first ``LENGTH`` bytes, which is as far as corpus order matters here.
   Neighbours that agree in all of them are one string; all but the earliest are repeats.
   Triggers with more than ``HOT`` dictionary phrases (the edges of a very common passage)
   are dealt by string instead, after a first sort where they are read.
4. Repeats of parse and dictionary are laid over the texts.

Documents that are whole copies are parsed once per task. Rows with one doc_id are the parts
of one document, in the order of a hash of their text: places carry that hash above
``PLACE_BITS`` bits, so each row loses only what is found in itself. Rows without doc_id are
documents of their own, in the order of that hash, before all others (real ids are not below
-2^62). Rows equal in both get equal results. A null text is empty; long texts are parsed in
overlapping pieces; no rows give none; other columns may have any name. Trigger and phrase
fingerprints have 64 bits each and both must agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.llm.arrays import CHUNK, U64, mix, spans, sums
from ledgertree.session import materialize

LENGTH = 100
TRIGGER = 32
HOT = 4_000
#: Whole texts that a task remembers.
SEEN = 200_000
#: Strings sorted at once.
SORT_STRINGS = 1 << 18
_PLACE_BITS = U64(22)
NO_ID = -(1 << 63)
#: Bits of a place that count bytes; a text is shorter. The row's number stands above.
PLACE_BITS = 31


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text): ``doc`` orders documents, ``row`` the rows of one id."""
    mark = F.xxhash64("text")
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(mark, 2)).alias("doc"),
        mark.bitwiseAND(F.lit((1 << 32) - 1)).alias("row"),
        "text",
    )


def _row_of(start: str) -> Column:
    return F.shiftright(start, PLACE_BITS)


def pieces(texts: list[tuple[int, int, bytes]], length: int = LENGTH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (doc, place, bytes) of about ``CHUNK`` bytes; pieces of a long text overlap by a string less one byte.

    A text comes with the place of its first byte.
    """
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, base, data in texts:
        for at in range(0, max(1, len(data) - length + 1), CHUNK):
            piece = data[at : at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            if part and size + len(piece) > CHUNK:
                yield part
                part, size = [], 0
            part.append((doc, base + at, piece))
            size += len(piece)
    if part:
        yield part


def parse(part: list[tuple[int, int, bytes]], length: int = LENGTH, width: int = TRIGGER) -> dict[str, np.ndarray]:
    """Phrases of some pieces: ``trigger`` and ``phrase`` fingerprints, ``doc``, ``start`` and ``strings``."""
    buf = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
    sizes = np.fromiter((len(x[2]) for x in part), np.int64, len(part))
    end = np.cumsum(sizes)
    run = sums(buf)
    at = np.arange(len(buf) - width + 1)
    gram = spans(run, at, at + width)
    least = (gram >> _PLACE_BITS << _PLACE_BITS) | at.astype(U64)
    reach, have = length - width + 1, 1
    while have < reach:  # minima of twice as many places each time
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = np.repeat(np.arange(len(part)), sizes)[: len(least)]
    whole = np.arange(len(least)) + length <= end[owner]
    spot = (least & ((U64(1) << _PLACE_BITS) - U64(1))).astype(np.int64)
    start = np.flatnonzero(whole)
    spot, owner = spot[start], owner[start]
    if not len(start):
        none = np.zeros(0, np.int64)
        return {"trigger": none, "phrase": none, "doc": none, "start": none, "strings": none}
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1]))))
    strings = np.diff(np.append(first, len(start)))
    begin = start[first]
    phrase = mix(spans(run, begin, begin + strings - 1 + length) + (spot[first] - begin).astype(U64))
    piece = owner[first]
    docs = np.fromiter((x[0] for x in part), np.int64, len(part))
    offset = np.fromiter((x[1] for x in part), np.int64, len(part))
    return {
        "trigger": gram[spot[first]].view(np.int64), "phrase": phrase.view(np.int64), "doc": docs[piece],
        "start": begin - (end - sizes)[piece] + offset[piece], "strings": strings,
    }


def _same_as_before(*keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys[0]), dtype=bool)
    out[:1] = False
    for key in keys:
        out[1:] &= key[1:] == key[:-1]
    return out


_ROWS = "trigger long, phrase long, doc long, start long, strings int"


def _table(trigger, phrase, doc, start, strings, known=None) -> pa.RecordBatch:
    """Rows of ``_ROWS``; where ``known`` is set the row is a repeat already and has no phrase."""
    return pa.RecordBatch.from_arrays(
        [pa.array(trigger), pa.array(phrase, mask=known), pa.array(doc), pa.array(start), pa.array(strings, pa.int32())],
        ["trigger", "phrase", "doc", "start", "strings"],
    )


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    for batch in batches:
        todo = []
        for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            if len(data) < LENGTH:
                continue
            mark = hashlib.blake2b(data, digest_size=16).digest()
            if seen.get(mark, doc + 1) <= doc:
                continue  # a copy of this text with a smaller id is parsed by this task
            if len(seen) >= SEEN:
                seen.clear()
            seen[mark] = doc
            todo.append((doc, row << PLACE_BITS, data))
        for part in pieces(todo):
            rows = parse(part)
            order = np.lexsort((rows["start"], rows["doc"], rows["phrase"], rows["trigger"]))
            rows = {k: v[order] for k, v in rows.items()}
            known = _same_as_before(rows["trigger"], rows["phrase"]) & ~_same_as_before(rows["doc"], rows["start"])
            # Repeats found here need no meeting with others; any task may have them.
            spread = mix(rows["doc"].astype(U64) + mix(rows["start"].astype(U64))).view(np.int64)
            rows["trigger"] = np.where(known, spread, rows["trigger"])
            yield _table(*rows.values(), known)


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated phrases (without trigger) and dictionary phrases that share a trigger, from sorted rows."""
    last: tuple[int, int] | None = None  # trigger and phrase of the row before
    place: tuple | None = None  # the whole row before
    waiting: list[np.ndarray] | None = None  # a lone dictionary phrase of the last trigger
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        columns = [batch.column(i).fill_null(0).to_numpy() for i in range(5)]
        repeats = [columns[i][known] for i in (2, 3, 4)]
        trigger, phrase, doc, start, strings = (c[~known] for c in columns)
        if len(trigger):  # a row that comes twice is one
            twin = _same_as_before(trigger, phrase, doc, start)
            twin[0] = place == (trigger[0], phrase[0], doc[0], start[0])
            place = (trigger[-1], phrase[-1], doc[-1], start[-1])
            trigger, phrase, doc, start, strings = (c[~twin] for c in (trigger, phrase, doc, start, strings))
        shared = np.zeros(0, bool)
        again = shared
        if len(trigger):
            same = _same_as_before(trigger)
            again = _same_as_before(trigger, phrase)
            same[0] = last is not None and last[0] == trigger[0]
            again[0] = bool(same[0]) and last[1] == phrase[0]
            group = np.cumsum(~same)  # 0 is the group that the last batch began
            heads = np.bincount(group[~again], minlength=group[-1] + 1)
            # The first group may have a phrase waiting, or phrases that were given out.
            before = 1 if same[0] else 0
            shared = ~again & ((heads[group] > 1) | ((group == 0) & (heads[0] + before > 1)))
            if waiting is not None and same[0]:
                if heads[0]:
                    yield _table(waiting[0], waiting[1], *waiting[2:])
                    waiting = None
            else:
                waiting = None
            alone = np.flatnonzero(~again & ~shared & (group == group[-1]))
            if len(alone) and not (group[-1] == 0 and before):
                waiting = [x[alone] for x in (trigger, phrase, doc, start, strings)]
            last = (int(trigger[-1]), int(phrase[-1]))
        done = [np.concatenate((a, x[again])) for a, x in zip(repeats, (doc, start, strings), strict=True)]
        zeros = np.zeros(len(done[0]), np.int64)
        yield _table(zeros, zeros, *done, known=np.ones(len(zeros), bool))
        yield _table(trigger[shared], phrase[shared], doc[shared], start[shared], strings[shared])


def repeats(rows: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of strings that also start earlier; rows come in order of document and start.

    A suffix array of the rows, cut at ``length``: equal neighbours are one string.
    """
    buf = np.frombuffer(b"".join(x[2] for x in rows), np.uint8)
    sizes = np.fromiter((len(x[2]) for x in rows), np.int64, len(rows))
    first = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    suffix = np.lib.stride_tricks.sliding_window_view(buf, length)[first[row] + place]
    suffix = np.ascontiguousarray(suffix).view(f"S{length}").ravel()
    order = np.argsort(suffix, kind="stable")
    later = order[_same_as_before(suffix[order])]
    return row[later], place[later]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary phrases with their bytes, from documents with the places of their phrases."""
    for batch in batches:
        kept: list[tuple] = []
        hot: list[tuple[int, int, bytes, int]] = []
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            for x in wanted:
                start, strings = x["start"], x["strings"]
                at = start & ((1 << PLACE_BITS) - 1)
                piece = data[at : at + strings - 1 + LENGTH]
                if len(piece) != strings - 1 + LENGTH:
                    continue  # a row of this id whose text has the same hash
                if x["hot"]:
                    hot.append((doc, start, piece, x["trigger"]))
                else:
                    kept.append((x["trigger"], doc, start, piece, False))
            if len(kept) > 20_000:
                yield _pack(kept)
                kept = []
            if len(hot) > 4_000:
                yield _deal(hot)
                hot = []
        if kept:
            yield _pack(kept)
        if hot:
            yield _deal(hot)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["trigger", "doc", "start", "piece", "known"],
    )


def _deal(hot: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
    """Each string of phrases with a hot trigger on its own; repeats among these are known at once."""
    hot = sorted({x[:2]: x for x in hot}.values(), key=lambda x: x[:2])  # rows that come twice are one
    row, place = repeats([x[:3] for x in hot])
    known = set(zip(row.tolist(), place.tolist(), strict=True))
    out = []
    for i, (doc, start, piece, _) in enumerate(hot):
        for k in range(len(piece) - LENGTH + 1):
            string = piece[k : k + LENGTH]
            if (i, k) in known:
                spread = hashlib.blake2b(b"%d %d" % (doc, start + k), digest_size=8).digest()
                out.append((int.from_bytes(spread, "little", signed=True), doc, start + k, b"", True))
            else:
                key = hashlib.blake2b(string, digest_size=8).digest()
                out.append((int.from_bytes(key, "little", signed=True), doc, start + k, string, False))
    return _pack(out)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, strings) of repeats among phrases that come sorted by trigger, document and start."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted({x[1:3]: x for x in rows}.values(), key=lambda x: x[1:3])  # rows that come twice are one
        row, place = repeats([x[1:4] for x in rows])
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        new = np.flatnonzero(~_same_as_before(row, place - np.arange(len(place)))) if len(row) else row
        docs = np.array([x[1] for x in rows], np.int64)[row[new]]
        starts = np.array([x[2] for x in rows], np.int64)[row[new]] + place[new]
        lengths = np.diff(np.append(new, len(row)))
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32())],
            ["doc", "start", "strings"],
        )

    held: list[tuple] = []
    strings = 0
    for batch in batches:
        known = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[4]:
                known.append(row)
                continue
            # Equal strings have equal triggers, so a run of whole trigger groups is sorted together.
            if strings > SORT_STRINGS and held[-1][0] != row[0]:
                yield found(held)
                held, strings = [], 0
            held.append(row)
            strings += len(row[3]) - LENGTH + 1
        if known:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[1] for x in known], pa.int64()), pa.array([x[2] for x in known], pa.int64()),
                    pa.array([1] * len(known), pa.int32()),
                ],
                ["doc", "start", "strings"],
            )
    if held:
        yield found(held)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc, start, strings): runs of string starts whose strings also start earlier.

    Whole copies of a text need not be among them, see ``deduplicated``.
    """
    own = _rows(docs).select("doc", "row", "text")
    rows = own.mapInArrow(_parse_rows, _ROWS).repartition("trigger")
    rows = rows.sortWithinPartitions("trigger", "phrase", "doc", "start").mapInArrow(_sort_out, _ROWS)
    rows = materialize(rows, "phrases")
    shared = rows.filter("phrase is not null")
    hot = shared.groupBy(F.col("trigger").alias("_hot")).count().filter(F.col("count") > HOT).select("_hot")
    shared = shared.join(hot, F.col("trigger") == F.col("_hot"), "left").select(
        "doc", F.struct("start", "strings", "trigger", F.col("_hot").isNotNull().alias("hot")).alias("x")
    )
    wanted = shared.groupBy(F.col("doc").alias("_doc"), _row_of("x.start").alias("_row")).agg(F.collect_list("x").alias("wanted"))
    texts = own.join(wanted, (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc", "text", "wanted")
    kind = "trigger long, doc long, start long, piece binary, known boolean"
    phrases = texts.mapInArrow(_strings, kind).repartition("trigger").sortWithinPartitions("trigger", "doc", "start")
    inside = phrases.mapInArrow(_suffixes, "doc long, start long, strings int")
    return rows.filter("phrase is null").select("doc", "start", "strings").unionByName(inside)


def remaining(data: bytes, starts: np.ndarray, strings: np.ndarray, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(bytes that stay, removed bytes, removed runs)."""
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    inside = starts + strings - 1 + length <= len(data)
    np.add.at(edge, starts[inside], 1)
    np.add.at(edge, (starts + strings - 1 + length)[inside], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the bytes that stay."""
    own = _rows(docs)
    # Later copies of a whole text are one run of repeats; found without moving the texts.
    marks = own.filter(F.octet_length("text") >= LENGTH).select(
        "doc", "row", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")
    )
    least = marks.groupBy(F.col("sha").alias("_sha")).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    copies = marks.join(least.filter("least < most"), (F.col("sha") == F.col("_sha")) & (F.col("doc") > F.col("least")))
    whole = copies.select("doc", F.shiftleft("row", PLACE_BITS).alias("start"), (F.col("size") - LENGTH + 1).alias("strings"))
    found = materialize(repeated_strings(docs).unionByName(whole), "repeats")
    at = F.col("start").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("start")
    ranges = found.groupBy(F.col("doc").alias("_doc"), _row_of("start").alias("_row")).agg(
        F.collect_list(F.struct(at, "strings")).alias("ranges")
    )
    rows = own.join(ranges, (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    rows = rows.select("doc_id", "text", "ranges")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    if ranges:
                        kept = remaining(
                            data, np.array([x["start"] for x in ranges]), np.array([x["strings"] for x in ranges])
                        )
                    else:
                        kept = (data, 0, 0)
                    out.append((len(data), *kept[1:], kept[0]))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
