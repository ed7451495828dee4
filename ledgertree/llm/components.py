"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertree.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b); the root is the component's smallest id.

    Each round is written once, so lineage stays short; minima are combined before the
    shuffle, so a node with very many edges costs its task no more than their number.
    """
    ends = edges.filter("a <> b")
    now = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "stars")
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")
        now = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.filter("v = m").select("u", F.col("m").alias("v"))
        )
        now = materialize(now.filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
