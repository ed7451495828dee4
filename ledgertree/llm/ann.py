"""Approximate nearest neighbours by inner product: lists, and an adaptive dimension scan.

The index turns vectors by one random rotation and puts each into the list of its nearest
centre. A query first ranks the vectors of its nearest lists in full; its ``K`` + 1st best
score is the bar for the other lists that it probes. Those are scanned in blocks of
``COLUMNS`` rotated columns, all of a list's queries at once. After each block a
hypothesis test looks at what a candidate can still reach: after a random rotation the
rest of an inner product is about normal with the variance |rest of q|^2 |rest of x|^2 /
(columns left), so a candidate that stays below the bar by more than ``SIGMAS`` deviations
is abandoned. Scores of what survives are computed on the original vectors in double
precision.

Inner products become distances by a further column sqrt(M^2 - |x|^2), M the largest norm.
Centres come from a sample of at most ``SAMPLE`` rows; every row is indexed. Equal vectors
are searched once: a vector carries its ``K`` + 1 smallest ids, as more never come into a
result, so a vector that a third of all rows share is one candidate. Lists and the queries
that probe them are cut into cells of bounded size.

Vectors that are null, zero, of a length other than the most common one, or hold null or
non-finite components take no part, nor do rows without an id. Repeated rows count once.
With fewer than ``K`` candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertree.session import materialize

K = 20
COLUMNS = 16
SIGMAS = 3.6
SAMPLE = 20_000
LIST_ROWS = 64
MAX_LISTS = 256
#: Share of all lists that a query probes; vectors without clusters need this many.
PROBE_SHARE = 0.6
#: Lists are probed until they hold so many vectors, however small the share.
LEAST_CANDIDATES = 2_000
#: Vectors of the nearest lists that are ranked in full for the bar.
FULL_ROWS = 512
CELL_ROWS = 4_096
QUERIES_AT_ONCE = 256
ROUNDS = 8


@dataclass
class Index:
    """What every task needs: its size is bounded by ``MAX_LISTS`` and the square of the columns."""

    rotation: np.ndarray
    centres: np.ndarray
    half_norms: np.ndarray
    top: float

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        extra = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.argmax(x @ self.centres[:, :-1].T + extra[:, None] * self.centres[:, -1] - self.half_norms, axis=1)

    def near(self, q: np.ndarray) -> np.ndarray:
        """Lists in the order in which each query should probe them."""
        return np.argsort(-(q @ self.centres[:, :-1].T - self.half_norms), axis=1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, key) of the vectors that take part; ``key`` is a hash of ``x``."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0))
    # Minus zero is equal to zero.
    return rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0))).withColumn("key", F.xxhash64("x"))


def train(sample: np.ndarray, lists: int, top: float, seed: int = 1) -> Index:
    """Rotation and centres from sample rows."""
    r = np.random.RandomState(seed)
    width = sample.shape[1]
    rotation, _ = np.linalg.qr(r.standard_normal((width, width)))
    points = np.column_stack((sample, np.sqrt(np.maximum(top**2 - (sample * sample).sum(axis=1), 0))))
    centres = points[r.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], points[r.choice(len(points), len(centres))])
    return Index(rotation, centres, 0.5 * (centres * centres).sum(axis=1), top)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def scan(
    x: np.ndarray, turned: np.ndarray, ids: np.ndarray, q: np.ndarray, q_turned: np.ndarray, bar: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of up to ``k`` rows for each query whose score may reach its ``bar``.

    ``turned`` and ``q_turned`` are ``x`` and ``q`` in rotated columns.
    """
    width = turned.shape[1]
    rest = lambda m, at: (m[:, at:] ** 2).sum(axis=1)
    part = q_turned[:, :COLUMNS] @ turned[:, :COLUMNS].T
    for at in range(COLUMNS, width + 1, COLUMNS):
        left = width - at
        if at == COLUMNS:
            spread = np.sqrt(rest(q_turned, at)[:, None] * rest(turned, at) / max(left, 1))
            who, row = np.nonzero(part + SIGMAS * spread >= bar[:, None])
            part = part[who, row]
        else:
            spread = np.sqrt(rest(q_turned, at)[who] * rest(turned, at)[row] / max(left, 1))
            good = part + SIGMAS * spread >= bar[who] - 1e-9 * (1 + np.abs(part))
            who, row, part = who[good], row[good], part[good]
        if left <= 0:
            break
        end = min(at + COLUMNS, width)
        part = part + np.einsum("ij,ij->i", q_turned[who, at:end], turned[row, at:end])
        if end == width:
            break
    good = part >= bar[who] - 1e-9 * (1 + np.abs(part))
    who, row = who[good], row[good]
    score = (q[who] * x[row]).sum(axis=1)
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    nth = np.arange(len(who)) - np.searchsorted(who, who)
    return who[nth < k], row[nth < k], score[nth < k]


def search(vectors: DataFrame, queries: Column, share: float = PROBE_SHARE, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each vector whose id meets ``queries``.

    ``queries`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    # Per vector its smallest ids; Spark limits each partition before the shuffle.
    first = Window.partitionBy("key", "x").orderBy("vec_id")
    own = rows.select("vec_id", "key", "x")
    widths = own.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths["width"]
    own = own.filter(F.size("x") == width)
    few = own.withColumn("_n", F.dense_rank().over(first)).filter(F.col("_n") <= k + 1)
    points = few.groupBy("key", "x").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    points = materialize(points.withColumn("u", F.element_at("ids", 1)), "points")
    facts = points.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("top"))
    facts = facts.first()
    sample = points.orderBy(F.xxhash64("u"), "u").limit(SAMPLE).select("x").toArrow()
    sample = _matrix(sample.column("x").combine_chunks(), width)
    lists = int(np.clip(round(facts["n"] / LIST_ROWS), 1, MAX_LISTS))
    shared = spark.sparkContext.broadcast(train(sample, lists, float(np.sqrt(facts["top"]))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.lists(_matrix(batch.column(2), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["u", "ids", "x", "list"])

    placed = points.select("u", "ids", "x").mapInArrow(assign, "u long, ids array<long>, x array<double>, list int")
    placed = materialize(placed, "lists")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)

    asked = own.filter(queries).select(F.col("vec_id").alias("query_id"), "key", "x").distinct()
    named = points.select("key", "x", "u")
    asked = materialize(asked.join(named, ["key", "x"]).select("query_id", "u"), "queries")
    seekers = placed.join(asked.select(F.col("u").alias("_u")).distinct(), F.col("u") == F.col("_u"), "left_semi")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = shared.value.near(_matrix(batch.column(1), width))
            reached = np.cumsum(held.value[order], axis=1)
            whole = reached[0, -1]
            full = np.argmax(reached >= min(FULL_ROWS, whole), axis=1) + 1
            enough = np.argmax(reached >= min(LEAST_CANDIDATES, whole), axis=1) + 1
            take = np.maximum(np.maximum(enough, int(np.ceil(share * order.shape[1]))), full)
            columns = [
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(b - a))), pa.int32()),
                    pa.array(np.concatenate([o[i:j] for o, i, j in zip(order, a, b, strict=True)]), pa.int32()),
                )
                for a, b in ((np.zeros_like(full), full), (full, take))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["q", "qx", "full", "more"])

    kind = "q long, qx array<double>, full array<int>, more array<int>"
    probed = materialize(seekers.select("u", "x").mapInArrow(probe, kind), "probes")

    def scan_cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            x, ids = _matrix(a.column("x").combine_chunks(), width), a.column("u").to_numpy()
            turned = x @ shared.value.rotation
            q, qx, bar = b.column("q").to_numpy(), _matrix(b.column("qx").combine_chunks(), width), b.column("bar").to_numpy()
            for at in range(0, len(q), QUERIES_AT_ONCE):
                one = qx[at : at + QUERIES_AT_ONCE]
                who, row, score = scan(x, turned, ids, one, one @ shared.value.rotation, bar[at : at + len(one)], k + 1)
                out.append((q[at + who], row, score))
        own, row, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        ids = a.column("ids").combine_chunks().take(pa.array(np.asarray(row, np.int64)))
        return pa.table({"q": pa.array(own, pa.int64()), "ids": ids, "score": pa.array(score, pa.float64())})

    def scanned(asked: DataFrame) -> DataFrame:
        """Results of (q, qx, bar, list) in cells: parts of a list's rows by parts of its queries."""
        number = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
        # At most MAX_LISTS rows.
        cuts = F.broadcast(number(placed, "row_cuts").join(number(asked, "query_cuts"), "list"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left, right = placed.join(cuts, "list"), asked.join(cuts, "list")
        left = left.withColumn("row_part", part("u", "row_cuts")).withColumn("query_part", every("query_cuts"))
        right = right.withColumn("query_part", part("q", "query_cuts")).withColumn("row_part", every("row_cuts"))
        cell = ["list", "row_part", "query_part"]
        both = left.select(*cell, "u", "ids", "x").groupBy(*cell).cogroup(
            right.select(*cell, "q", "qx", "bar").groupBy(*cell)
        )
        return both.applyInArrow(scan_cell, "q long, ids array<long>, score double")

    none = F.lit(float("-inf"))
    first = materialize(
        scanned(probed.select("q", "qx", none.alias("bar"), F.explode("full").alias("list"))), "first-scan"
    )
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    bars = first.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") == k + 1)
    bars = bars.select(F.col("q").alias("_q"), F.col("score").alias("bar"))
    rest = probed.join(bars, F.col("q") == F.col("_q"), "left")
    rest = rest.select("q", "qx", F.coalesce("bar", none).alias("bar"), F.explode("more").alias("list"))
    found = first.unionByName(scanned(rest))
    near = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1)
    best = best.select("q", "score", F.explode("ids").alias("vec_id"))
    order = F.struct((-F.col("score")).alias("less"), "vec_id")
    best = best.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("best"))
    rows = asked.join(best, F.col("u") == F.col("q"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    rows = rows.select("query_id", F.posexplode(others).alias("_at", "_b"))
    return rows.select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"),
        (-F.col("_b.less")).alias("score"),
    )
