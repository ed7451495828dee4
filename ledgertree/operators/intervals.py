"""Interval labels of a folder tree: a subtree is a range of numbers.

Every folder gets the number ``enter``, in an order in which each subtree stands together,
and ``leave``, the number after the last one of its subtree. What lies below a folder is
then a range of one column: a predicate that a scan pushes down to row groups when facts
are stored by the label of their folder (:func:`labelled`). Sums below a folder are the
difference of two running sums, so a rollup costs a join of folders with folders, not
folders times depth.

The numbers come from the ancestor chains: the folders of a subtree are counted first; a
folder's distance from its parent is one plus the sizes of its siblings' subtrees before
it, by a running sum that splits hot parents; its number is the sum of the distances along
its chain. Numbers of a volume are dense, from 0, and depend on that volume alone.

Folders in or below a ring of parents are in each other's subtrees, which no ranges can
tell; they get no number, and the functions here answer for them by their chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertree.operators.ordered import CHUNK_ROWS, Ordered
from ledgertree.session import materialize

_KEYS = ["volume", "file_id"]


def labels(chain: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(volume, file_id, enter, leave) of every folder that is not in or below a ring."""
    plain = chain.filter(~F.col("looped"))
    steps = materialize(
        plain.select("volume", "file_id", F.get("visited.id", F.lit(1)).alias("parent"), F.explode("visited.id").alias("above")), "steps"
    )
    sizes = steps.groupBy("volume", F.col("above").alias("file_id")).agg(F.count("*").alias("size"))
    own = steps.filter(F.col("above") == F.col("file_id")).select("volume", "file_id", "parent")
    # Folders without a known parent are siblings of each other.
    sized = own.join(sizes, _KEYS).withColumn("top", F.col("parent").isNull()).fillna(0, ["parent"])
    placed = Ordered(sized, ["volume", "top", "parent"], "file_id", chunk_rows).look_back(total={"before": F.col("size")}).df
    distance = placed.select("volume", F.col("file_id").alias("above"), F.when(F.col("top"), 0).otherwise(1).alias("step"), "before")
    numbered = steps.join(distance, ["volume", "above"]).groupBy(*_KEYS).agg(F.sum(F.col("step") + F.col("before")).alias("enter"))
    return numbered.join(sizes, _KEYS).select(*_KEYS, "enter", (F.col("enter") + F.col("size")).alias("leave"))


def relabelled(old: DataFrame, chain: DataFrame, changed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Labels after folders changed: volumes that hold one of ``changed`` are numbered anew."""
    touched = materialize(changed.select("volume").distinct(), "touched")
    kept = old.join(touched, "volume", "left_anti")
    return kept.unionByName(labels(chain.join(touched, "volume", "left_semi"), chunk_rows).select(*old.columns))


def labelled(facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``facts`` with ``at``, the number of the folder each row lies in; NULL where it has none.

    Store it in the order of volume and ``at``.
    """
    folders = numbers.select("volume", F.col("file_id").alias("parent_file_id"), F.col("enter").alias("at"))
    return facts.join(folders, ["volume", "parent_file_id"], "left").select(*facts.columns, "at")


def subtree(stored: DataFrame, numbers: DataFrame, chain: DataFrame, volume: str, root_id: int) -> DataFrame:
    """Rows strictly below a folder, as ``tree.subtree``; ``stored`` is :func:`labelled`.

    One look at the labels gives the range. A folder without number is in or below a ring;
    its subtree is then found by the chains, as are rings that hang below no folder.
    """
    here = stored.filter((F.col("volume") == volume) & (F.col("file_id") != root_id))
    span = numbers.filter((F.col("volume") == volume) & (F.col("file_id") == root_id)).select("enter", "leave").first()
    if span is not None:
        return here.filter((F.col("at") >= span.enter) & (F.col("at") < span.leave)).drop("at")
    ringed = chain.filter((F.col("volume") == volume) & F.col("looped") & F.array_contains("visited.id", root_id))
    return here.join(ringed.select("volume", F.col("file_id").alias("parent_file_id")), ["volume", "parent_file_id"], "left_semi").select(
        *[c for c in stored.columns if c != "at"]
    )


def folders_below(numbers: DataFrame, volume: str, root_id: int) -> DataFrame | None:
    """(volume, file_id) of the folders strictly below one, or None if it has no number."""
    mine = numbers.filter(F.col("volume") == volume)
    span = mine.filter(F.col("file_id") == root_id).select("enter", "leave").first()
    if span is None:
        return None
    return mine.filter((F.col("enter") > span.enter) & (F.col("enter") < span.leave)).select(*_KEYS)


def roll_up(numbers: DataFrame, chain: DataFrame, direct: DataFrame, values: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the ``values`` of each folder to itself and all its ancestors.

    ``direct`` is one row per (volume, parent_file_id). A folder's sum is what is before its
    ``leave`` less what is before its ``enter``. Ringed folders are summed along their chains.
    """
    held = numbers.join(direct.withColumnRenamed("parent_file_id", "file_id"), _KEYS, "left").fillna(0, values)
    before = {f"before_{v}": F.col(v) for v in values}
    running = materialize(Ordered(held, ["volume"], "enter", chunk_rows).look_back(total=before).df.select(
        *_KEYS, "enter", "leave", *values, *before
    ), "running")
    # Numbers are dense, so the folder numbered ``leave`` knows the sum up to there; past the last the whole sum stands.
    at_leave = running.select("volume", F.col("enter").alias("leave"), *[F.col(b).alias(f"upto_{b}") for b in before])
    whole = running.groupBy("volume").agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    found = running.join(at_leave, ["volume", "leave"], "left").join(whole, "volume")
    sums = [(F.coalesce(F.col(f"upto_before_{v}"), F.col(f"all_{v}")) - F.col(f"before_{v}")).alias(v) for v in values]
    out = found.select(*_KEYS, *sums)
    ringed = chain.filter("looped").join(direct.withColumnRenamed("parent_file_id", "file_id"), _KEYS, "left")
    of_rings = ringed.select("volume", F.explode("visited.id").alias("file_id"), *values).groupBy(*_KEYS).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]
    )
    both = out.unionByName(of_rings).groupBy(*_KEYS).agg(*[F.sum(v).cast("long").alias(v) for v in values])
    names = chain.select(*_KEYS, F.get("visited.name", F.lit(0)).alias("name"))
    return names.join(both, _KEYS).select(*_KEYS, "name", *values)


def rollup_sizes(facts: DataFrame, numbers: DataFrame, chain: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per folder: bytes and number of all files beneath, as ``tree.rollup_sizes``."""
    direct = (
        facts.filter("not is_directory")
        .groupBy("volume", "parent_file_id")
        .agg(F.sum("size").alias("size"), F.count("*").alias("item_count"))
    )
    return roll_up(numbers, chain, direct, ["size", "item_count"], chunk_rows)
