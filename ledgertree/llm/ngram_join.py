"""N-gram Jaccard join: documents whose sets of word shingles overlap, without loss.

Two documents link when ``100 * intersection >= percent * union`` of their distinct
shingles of ``words`` words; op6 has ``PERCENT`` and ``WORDS``. Shingles are hashed into groups, and a document is a point whose
coordinates are its group contents.

1. Tiles. Sizes fall into classes such that linked sets are in one class or neighbours. In
   class k linked sets differ in at most d shingles, so of more than d groups some have equal
   contents on both sides. A set's tiles are its non-empty groups with their contents (the
   empty ones too, should it have no more than d others; there are an eighth more groups than
   d, as empty ones are alike in unrelated sets). Of f non-empty groups, linked sets share
   f - d or more. So a set that shares fewer tiles has no links, and each set leaves out
   its f - d - 1 most common tiles: linked sets still meet in the rarest one they share.
   Sets of a tile meet under its smallest one; exact copies count once.
2. R-tree. Sets that meet are points of ``DIMENSIONS`` group counts or more (about a
   group for eight shingles), packed by size into leaves with their coordinate maxima. The
   sum of coordinate minima bounds the overlap, first for a leaf, then for a point. This is
   done on the points alone, which are a thirtieth of the sets. Only pairs that pass make
   clusters (``components``), so sets that merely share common shingles do not grow into one.
3. Sets of a cluster are fetched, and pairs are verified on the sets themselves.
   Groups and clusters above ``LEAF_SETS`` sets are cut by size class and hash into parts, and pairs
   of parts that may hold links are separate groups, so no task holds a whole large one.

Shingles are 64-bit fingerprints, and so is a set's identity. Null and empty texts have no
shingles and link with nothing. Texts of fewer words are one shingle. Rows with equal ids
are taken as one document with several texts and end in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgertree.llm.arrays import U64, Words, chunks, mix, ngrams
from ledgertree.llm.components import components
from ledgertree.llm.registry import free_names
from ledgertree.session import materialize

WORDS = 4
PERCENT = 85
DIMENSIONS = 128
LEAF_SETS = 1_500
#: A group of points may have so many times the sets.
POINT_LEAVES = 4
NODE = 32
#: Points that a set is compared with before it leaves out those it is joined with by now.
STEP = 256
#: Sets a task remembers to leave out exact copies that it meets again.
SEEN = 500_000


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, fingerprints): each text's distinct shingles, one text after another, sorted."""
    w = Words(texts, lower=True)
    counts = w.counts()
    gram = ngrams(w.hash, words)
    whole = np.flatnonzero(w.doc[: len(gram)] == w.doc[words - 1 :]) if len(gram) else np.zeros(0, np.int64)
    hashes, owners = [gram[whole]], [w.doc[whole]]
    first = np.cumsum(counts) - counts
    for k in range(1, words):
        short = np.flatnonzero(counts == k)
        if len(short):
            hashes.append(ngrams(w.hash, k)[first[short]])
            owners.append(short)
    value, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[new], owner[new]
    return np.bincount(owner, minlength=len(texts)), value


def set_ids(sizes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    run = np.concatenate((np.zeros(1, U64), np.cumsum(mix(value + U64(17)))))
    end = np.cumsum(sizes)
    return mix(run[end] - run[end - sizes] + mix(sizes.astype(U64))).view(np.int64)


def class_starts(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Smallest size of each size class, up to one that holds ``largest``."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array([*starts, 100 * starts[-1] // percent + 1], dtype=np.int64)


def tiles(sizes: np.ndarray, value: np.ndarray, percent: int = PERCENT, needs: bool = False) -> tuple[np.ndarray, ...]:
    """(tile, set index) of the sets, see the module's text.

    With ``needs`` also how many tiles of this level a linked set shares with the tile's set
    at least, doubled, plus 1 in the upper one of the set's two levels.
    """
    if not len(value):
        return (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))[: 2 + needs]
    starts = class_starts(int(sizes.max()), percent)
    own = np.searchsorted(starts, sizes, side="right") - 1
    code = mix(value + U64(29))
    keys, owners, need = [], [], []
    for step in (0, 1):
        level = np.maximum(own, 0) + step
        top = starts[level + 1] - 1
        d = 2 * top * (100 - percent) // (100 + percent)
        groups = np.where((d > 0) & (sizes > 0), d + 4 + d // 8, 0)
        first = np.cumsum(groups) - groups
        of = np.repeat(np.arange(len(sizes)), sizes)
        used = groups[of] > 0
        place = first[of[used]] + (mix(code[used] + level[of[used]].astype(U64)) % groups[of[used]].astype(U64)).astype(np.int64)
        total = int(groups.sum())
        content = np.zeros(total, U64)
        np.add.at(content, place, code[used])
        filled = np.bincount(place, minlength=total) > 0
        owner = np.repeat(np.arange(len(sizes)), groups)
        some = np.bincount(owner[filled], minlength=len(sizes))
        kept = np.flatnonzero(filled | (some <= d)[owner])
        within = (kept - first[owner[kept]]).astype(U64)
        keys.append(mix(content[kept] + mix(within + (level[owner[kept]].astype(U64) << U64(40)))))
        owners.append(owner[kept])
        # A set of few filled groups may meet one that leaves its empty groups out.
        need.append((2 * np.maximum(some - d, 1) + step)[owner[kept]])
    return (np.concatenate(keys), np.concatenate(owners), np.concatenate(need))[: 2 + needs]


def dimensions(sizes: np.ndarray) -> np.ndarray:
    """Groups that a set of each size is counted in: a power of two, so that finer counts add up to coarser."""
    return np.maximum(DIMENSIONS, 1 << np.ceil(np.log2(np.maximum(sizes, 8) / 8)).astype(np.int64))


def points(sizes: np.ndarray, value: np.ndarray) -> list[bytes]:
    """Group counts of each set, as 16-bit numbers."""
    wide = dimensions(sizes)
    start = np.cumsum(wide) - wide
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = start[owner] + (mix(value) & (wide[owner] - 1).astype(U64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(wide.sum())), 65_535).astype("<u2")
    return [counts[a : a + n].tobytes() for a, n in zip(start.tolist(), wide.tolist(), strict=True)]


def with_partner(
    n: np.ndarray, packed: list[bytes], side: np.ndarray, two: bool, percent: int = PERCENT,
    tree: list[tuple[int, int]] | None = None,
) -> np.ndarray:
    """Which sets of a group may link with another, by their points; of ``two`` parts, with one of the other side.

    ``tree`` gets pairs that may link and join all such pairs' sets with each other.
    """
    order = np.argsort(n, kind="stable")
    size, sides = n[order], side[order]
    own = [np.frombuffer(packed[i], "<u2").astype(np.int32) for i in order]
    wide = np.array([len(x) for x in own])
    nodes = np.arange(0, len(size), NODE)
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(width: int) -> tuple[np.ndarray, np.ndarray]:
        """The points at least so wide, folded to that width, and the maxima of all nodes."""
        if width not in made:
            point = np.zeros((len(size), width), dtype=np.int32)
            for i in range(int(np.searchsorted(wide, width)), len(size)):
                point[i] = own[i].reshape(-1, width).sum(axis=0)
            made[width] = point, np.maximum.reduceat(point, nodes, axis=0)
        return made[width]

    alive = np.zeros(len(size), dtype=bool)
    # Sets that may link, directly or through others, have one number; nothing is left to find among them.
    joint = np.arange(len(size))
    for i in range(1, len(size)):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        if low >= i:
            continue
        point, maxima = at_width(int(wide[low]))
        near = np.arange(low // NODE, (i - 1) // NODE + 1)
        bound = np.minimum(maxima[near], point[i]).sum(axis=1)
        near = near[(100 + percent) * bound >= percent * (size[i] + np.maximum(size[nodes[near]], size[low]))]
        js = (near[:, None] * NODE + np.arange(NODE)).ravel()
        js = js[(js >= low) & (js < i)]
        if two:
            js = js[sides[js] != sides[i]]
        js = js[joint[js] != joint[i]]
        while len(js):
            at, js = js[:STEP], js[STEP:]
            bound = np.minimum(point[at], point[i]).sum(axis=1)
            at = at[(100 + percent) * bound >= percent * (size[i] + size[at])]
            if len(at):
                alive[i] = True
                alive[at] = True
                found, lead = np.unique(joint[at], return_index=True)
                if tree is not None:
                    tree.extend((int(order[i]), int(order[j])) for j in at[lead])
                joint[np.isin(joint, found)] = joint[i]
                js = js[joint[js] != joint[i]]
    out = np.zeros(len(size), dtype=bool)
    out[order] = alive
    return out


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_id, point); set and point are null without shingles."""
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                sizes, value = shingle_sets(texts, words)
                ids = pa.array(set_ids(sizes, value), mask=sizes == 0)
                point = pa.array(points(sizes, value), pa.binary(), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes), ids, point],
                    ["doc_id", "n_shingles", "set_id", "point"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_shingles long, set_id long, point binary")


def tile_edges(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): sets that share a tile, each with the smallest one of the tile.

    Tiles that show nothing are left out, see the module's text: those of sets that share too
    few for a link, and of each set the most common ones, one fewer than a link needs.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch.column(0).to_pylist()):
                sizes, value = shingle_sets(texts, words)
                ids = set_ids(sizes, value)
                listed = ids.tolist()
                new = np.array([x not in seen for x in listed], dtype=bool)
                _, lead = np.unique(ids, return_index=True)
                once = np.zeros(len(ids), dtype=bool)
                once[lead] = True
                new &= once
                if len(seen) + len(listed) > SEEN:
                    seen.clear()
                seen.update(listed)
                value = value[np.repeat(new, sizes)]
                tile, owner, need = tiles(sizes[new], value, percent, needs=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile.view(np.int64)), pa.array(ids[new][owner]), pa.array(need.astype(np.int32))],
                    ["tile", "set_id", "need"],
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of tiles with two sets or more, each set once; the last row waits for the next batch."""
        held, open_tile = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            tile, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Copies that other tasks have met follow each other.
            first = np.concatenate(([True], (tile[1:] != tile[:-1]) | (own[1:] != own[:-1])))
            batch, tile = batch.filter(pa.array(first)), tile[first]
            same = np.concatenate(([tile[0] == open_tile], tile[1:] == tile[:-1]))
            held, keep = batch.slice(len(tile) - 1), same.copy()
            keep[:-1] |= same[1:]
            # Whether the row that waits has company so far.
            open_tile = tile[-1] if same[-1] else None
            yield batch.slice(0, len(tile) - 1).filter(pa.array(keep[:-1]))
        if held is not None and open_tile is not None:
            yield held

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lead = None
        for batch in batches:
            tile, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(tile):
                continue
            start = np.concatenate(([tile[0] != last], tile[1:] != tile[:-1]))
            head = np.maximum.accumulate(np.where(start, np.arange(len(tile)), -1))
            first = own[np.maximum(head, 0)]
            if not start[0]:
                first[head < 0] = lead
            last, lead = tile[-1], first[-1]
            apart = first != own
            pair = np.unique(np.column_stack((first[apart], own[apart])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    rows = docs.select("text").mapInArrow(emit, "tile long, set_id long, need int")
    ordered = rows.repartition("tile").sortWithinPartitions("tile", "set_id")
    met = materialize(ordered.mapInArrow(shared, "tile long, set_id long, need int"), "tiles")
    common = met.groupBy(F.col("tile").alias("_tile")).agg(F.count("*").alias("sets"))
    level = Window.partitionBy("set_id", "need")
    ranked = (
        met.join(common, F.col("tile") == F.col("_tile"))
        .withColumn("place", F.row_number().over(level.orderBy(F.desc("sets"), "tile")))
        .filter(F.col("place") >= F.shiftright("need", 1))
    )
    return ranked.select("tile", "set_id").repartition("tile").sortWithinPartitions("tile", "set_id").mapInArrow(
        link, "a long, b long"
    ).distinct()


def parts(members: DataFrame, leaf: int = LEAF_SETS, percent: int = PERCENT) -> DataFrame:
    """``members`` (cluster, set_id, n_shingles) once for each group it is joined in: ``pair`` and ``side``.

    A cluster of at most ``leaf`` sets is one group. Larger ones are cut into parts by size
    class and hash; a part meets itself, the other parts of its class and those of the next.
    """
    bounds = class_starts(1 << 40, percent)
    starts = F.array(*(F.lit(int(x)) for x in bounds))
    rows = members.withColumn("_starts", starts).withColumn(
        "band", F.expr("size(filter(_starts, s -> s <= n_shingles))")
    ).drop("_starts")
    total = rows.groupBy("cluster").agg(F.count("*").alias("cluster_sets"))
    banded = rows.groupBy("cluster", "band").agg(F.count("*").alias("sets"))
    rows = rows.join(total, "cluster").withColumn("small", F.col("cluster_sets") <= leaf)
    small = rows.filter("small").select(
        *members.columns, F.concat_ws(":", "cluster").alias("pair"), F.lit(0).alias("side"), F.lit(True).alias("same")
    )
    cut = banded.withColumn("cuts", F.ceil(F.col("sets") / leaf).cast("int")).drop("sets")
    large = rows.filter("not small").join(cut, ["cluster", "band"])
    large = large.withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("cuts")).cast("int"))
    for name, step in (("below", 1), ("above", -1)):
        shifted = cut.select("cluster", (F.col("band") + step).alias("band"), F.col("cuts").alias(name))
        large = large.join(shifted, ["cluster", "band"], "left")
    groups = F.expr(
        """
        concat(
          transform(sequence(0, cuts - 1), q -> named_struct(
            'pair', concat_ws(':', cluster, band, least(part, q), band, greatest(part, q)),
            'side', if(part <= q, 0, 1), 'same', part = q)),
          if(above is null, array(), transform(sequence(0, above - 1), q -> named_struct(
            'pair', concat_ws(':', cluster, band, part, band + 1, q), 'side', 0, 'same', false))),
          if(below is null, array(), transform(sequence(0, below - 1), q -> named_struct(
            'pair', concat_ws(':', cluster, band - 1, q, band, part), 'side', 1, 'same', false)))
        )"""
    )
    large = large.withColumn("_group", F.explode(groups)).select(
        *members.columns, "_group.pair", "_group.side", "_group.same"
    )
    return small.unionByName(large)


def joined(
    sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, two: bool, percent: int = PERCENT
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(tree of links, links of each set counting copies) among the sets of one group.

    Of ``two`` parts only sets of different sides are joined; one of them may have no sets.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    size = n[order]
    value, place = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    first = np.cumsum(size) - size
    group = (mix(value) % U64(DIMENSIONS)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    point = np.bincount(owner * DIMENSIONS + group[place], minlength=len(size) * DIMENSIONS)
    point = point.reshape(len(size), DIMENSIONS).astype(np.int32)
    nodes = np.arange(0, len(size), NODE)
    maxima, smallest = np.maximum.reduceat(point, nodes, axis=0), size[nodes]
    sides = side[order]
    root = list(range(len(size)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    tree, links, mark = [], np.zeros(len(size), np.int64), np.zeros(len(value), bool)
    weight = copies[order]
    for i in range(1, len(size)):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        if low >= i:
            continue
        near = np.arange(low // NODE, (i - 1) // NODE + 1)
        bound = np.minimum(maxima[near], point[i]).sum(axis=1)
        near = near[(100 + percent) * bound >= percent * (size[i] + np.maximum(smallest[near], size[low]))]
        if not len(near):
            continue
        js = (near[:, None] * NODE + np.arange(NODE)).ravel()
        js = js[(js >= low) & (js < i)]
        if two:
            js = js[sides[js] != sides[i]]
        bound = np.minimum(point[js], point[i]).sum(axis=1)
        js = js[(100 + percent) * bound >= percent * (size[i] + size[js])]
        if not len(js):
            continue
        own = place[first[i] : first[i] + size[i]]
        mark[own] = True
        spots = np.repeat(first[js] - np.cumsum(size[js]) + size[js], size[js]) + np.arange(int(size[js].sum()))
        common = np.add.reduceat(mark[place[spots]].astype(np.int64), np.cumsum(size[js]) - size[js])
        mark[own] = False
        js = js[(100 + percent) * common >= percent * (size[i] + size[js])]
        links[i] += weight[js].sum()
        links[js] += weight[i]
        for j in js.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                tree.append((int(order[i]), int(order[j])))
    out = np.zeros(len(size), np.int64)
    out[order] = links
    return tree, out


def _join_group(table: pa.Table, percent: int) -> pa.Table:
    ids = table.column("set_id").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    two = not table.column("same")[0].as_py()
    tree, links = joined(sets, table.column("copies").to_numpy(), table.column("side").to_numpy(), two, percent)
    a = [int(ids[i]) for i, _ in tree] + ids.tolist()
    b = [int(ids[j]) for _, j in tree] + [None] * len(ids)
    return pa.table(
        {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
         "links": pa.array([0] * len(tree) + links.tolist(), pa.int64())}
    )


def linked_sets(docs: DataFrame, leaf: int, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id) of every row, and (_set, root, component_id, n_links) of every set.

    A component's id is null if only rows without an id hold its sets.
    """
    own = materialize(fingerprinted(docs, words), "sets")
    distinct = own.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")
    )
    edges = materialize(tile_edges(docs, words, percent), "tile-edges")
    met = edges.select(F.col("a").alias("cluster"), F.col("b").alias("set_id")).union(edges.select("a", F.col("a").alias("b")).distinct())
    met = met.join(distinct.select(F.col("set_id").alias("_set"), "n_shingles"), F.col("set_id") == F.col("_set"))
    met = materialize(met.select("cluster", "set_id", "n_shingles"), "met")

    at = own.select(F.col("set_id").alias("_set"), "point").join(
        met.select(F.col("set_id").alias("_member")), F.col("_set") == F.col("_member"), "left_semi"
    )
    # Points are small, so their groups may be larger, and a set is in fewer of them.
    spread = parts(met, POINT_LEAVES * leaf, percent)
    rows = spread.join(at.dropDuplicates(["_set"]), F.col("set_id") == F.col("_set"))

    def prune(table: pa.Table) -> pa.Table:
        n, side = table.column("n_shingles").to_numpy(), table.column("side").to_numpy()
        tree: list[tuple[int, int]] = []
        with_partner(n, table.column("point").to_pylist(), side, not table.column("same")[0].as_py(), percent, tree)
        i, j = np.array(tree, dtype=np.int64).reshape(-1, 2).T
        ids = table.column("set_id").to_numpy()
        return pa.table({"a": pa.array(ids[i]), "b": pa.array(ids[j])})

    rows = rows.select("pair", "set_id", "n_shingles", "side", "same", "point").groupBy("pair")
    clusters = components(rows.applyInArrow(prune, "a long, b long"))
    clusters = clusters.select(F.col("id").alias("_asked"), F.col("root").alias("cluster"))
    left = distinct.join(clusters, F.col("set_id") == F.col("_asked")).drop("_asked")
    left = materialize(left, "alive")
    wanted = left.select(F.col("rep").alias("_rep"), F.col("set_id").alias("_set"))
    # The members grow with the documents, so they are not to be broadcast at any size.
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("_rep"))
    # Rows without an id cannot be asked for; all of them are read, and the set is worked out.
    no_id = docs.filter("doc_id is null").select("text", F.lit(None).cast("long").alias("_set"))
    texts = texts.select("text", "_set").union(no_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(0).to_pylist()):
                sizes, value = shingle_sets(part, words)
                asked = batch.column(1).slice(at, len(part))
                # An id may have several texts; only the one that was asked for counts.
                found = pa.array(set_ids(sizes, value))
                right = pc.and_(pc.fill_null(pc.equal(found, asked), True), pa.array(sizes > 0))
                packed = [x.tobytes() for x in np.split(value, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([found, pa.array(packed)], ["_set", "shingles"]).filter(right)

    sets = texts.mapInArrow(work, "_set long, shingles binary").dropDuplicates(["_set"])
    spread = parts(left.select("cluster", "set_id", "n_shingles", "copies"), leaf, percent)
    rows = spread.join(sets, F.col("set_id") == F.col("_set")).select("pair", "set_id", "copies", "side", "same", "shingles")

    def join(table: pa.Table) -> pa.Table:
        return _join_group(table, percent)

    found = materialize(rows.groupBy("pair").applyInArrow(join, "a long, b long, links long"), "links")

    roots = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("_linked")).agg(F.sum("links").alias("links"))
    named = (
        distinct.join(roots, F.col("set_id") == F.col("id"), "left")
        .join(links, F.col("set_id") == F.col("_linked"), "left")
        .select("set_id", "rep", "copies", F.coalesce("root", "set_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = materialize(named, "named")
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("_root")).select(
        F.col("set_id").alias("_set"), "root", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    return own, named


def classes(docs: DataFrame, leaf: int = LEAF_SETS, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``."""
    own, named = linked_sets(docs, leaf, words, percent)
    return own.join(named, F.col("set_id") == F.col("_set"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, with the columns it came with.

    Of a component without ids one row stays; rows that have neither id nor words stay.
    """
    key, own_set = free_names(docs.columns, "_id", "_own")
    own, named = linked_sets(docs, LEAF_SETS, words, percent)
    rows = own.join(named, F.col("set_id") == F.col("_set"), "left")
    kept = rows.filter("doc_id = coalesce(component_id, doc_id)").select(F.col("doc_id").alias(key)).distinct()
    with_id = docs.join(kept, F.col("doc_id") == F.col(key), "left_semi")

    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(at).to_pylist()):
                sizes, value = shingle_sets(texts, words)
                ids = pa.array(set_ids(sizes, value), mask=sizes == 0)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, own_set])

    no_id = docs.filter("doc_id is null")
    no_id = no_id.mapInArrow(work, StructType([*docs.schema.fields, StructField(own_set, LongType())]))
    alone = named.filter("component_id is null and _set = root").select(F.col("_set").alias(key))
    one = no_id.dropDuplicates([own_set]).join(alone, F.col(own_set) == F.col(key), "left_semi")
    return with_id.union(no_id.filter(F.col(own_set).isNull()).union(one).select(*docs.columns))
