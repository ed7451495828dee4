"""Flat file listings to a parent-pointer tree, and merging scans into facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.functions.text import prefixes, segments
from ledgertree.operators.bounds import drop_volumes
from ledgertree.schema import ARCHIVE, DIRECTORY, HIDDEN


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified_at) of every file below a folder, contents unread.

    Spark's file sources pass over names that begin with "." or "_"; where those
    matter, give :func:`inventory_from_paths` a listing made elsewhere.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified_at"))


def inventory_from_paths(listing: DataFrame, volume: str = "/") -> DataFrame:
    """Facts of a listing with ``path``, ``length``, ``modified_at``.

    One row per file and per folder above one. Ids hash the volume and path, so
    they are stable between scans and need no coordination; two paths with one id
    fail the job. A path listed twice
    keeps its largest length and latest time; a path that is also a folder of
    another counts as folder.
    """
    parts = segments(F.col("path"))
    cut = listing.select(parts.alias("parts"), "length", "modified_at").filter(F.size("parts") > 0)
    each = cut.select(
        F.posexplode(F.concat(F.array(F.lit("")), prefixes(F.col("parts")))).alias("depth", "node"),
        F.size("parts").alias("n"),
        "length",
        "modified_at",
    )
    is_file = F.col("depth") == F.col("n")
    nodes = each.groupBy(F.xxhash64(F.lit(volume), "node").alias("file_id")).agg(
        F.min("node").alias("node"),
        F.max("node").alias("_other"),
        F.max(F.when(is_file, F.col("length"))).alias("length"),
        F.max("modified_at").alias("modified_at"),
        F.max(~is_file).alias("is_directory"),
    )
    # Two paths with one id would become one file: better no result than that one.
    clash = F.raise_error(F.concat(F.lit("two paths share an id: "), "node", F.lit(" and "), "_other"))
    nodes = nodes.withColumn("node", F.when(F.col("node") == F.col("_other"), F.col("node")).otherwise(clash))
    vol = F.lit(volume)
    last = F.substring_index("node", "/", -1)
    up = F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", "")).otherwise(F.lit(""))
    bits = F.when(F.col("is_directory"), F.lit(DIRECTORY)).otherwise(F.lit(ARCHIVE)) + F.when(
        last.startswith("."), F.lit(HIDDEN)
    ).otherwise(F.lit(0))
    return nodes.select(
        vol.alias("volume"),
        "file_id",
        F.xxhash64(vol, up).alias("parent_file_id"),
        F.when(F.col("node") == "", vol).otherwise(last).alias("name"),
        "is_directory",
        F.when(F.col("is_directory"), F.lit(0)).otherwise(F.col("length")).cast("long").alias("size"),
        F.col("modified_at").alias("created_at"),
        "modified_at",
        F.when(F.col("node") == "", F.lit(DIRECTORY)).otherwise(bits).alias("attributes"),
    )


def baseline_merge(facts: DataFrame, scan: DataFrame, purge: bool = False) -> DataFrame:
    """Facts after a fresh scan.

    The scan replaces every column but ``created_at``, which survives. With
    ``purge``, facts of a scanned volume that the scan did not meet are dropped;
    other volumes are untouched.
    """
    keys = ["volume", "file_id"]
    columns = [c for c in scan.columns if c not in keys and c != "created_at"]
    old = facts.select(*keys, F.struct(*facts.columns).alias("old"))
    new = scan.select(*keys, F.struct(*scan.columns).alias("new"))
    both = old.join(new, keys, "full_outer")
    if purge:
        stale = drop_volumes(both.filter("new is null"), scan.select("volume").distinct())
        both = both.filter("new is not null").unionByName(stale)
    picked = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in columns}
    picked["created_at"] = F.coalesce("old.created_at", "new.created_at")
    return both.select(*[F.col(c) if c in keys else picked[c].alias(c) for c in scan.columns])


def upsert_latest(table: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert or replace by key; the newest time wins, and of equal times the new row.

    A row without time is older than any with one.
    """
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "_new")).alias("r"))
    return merged.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in table.columns])
