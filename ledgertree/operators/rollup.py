"""Folder sums kept up to date: the table of ``tree.rollup_sizes`` after a batch of log rows.

The stored table has, for each folder, the sums of all files beneath and those of its own
files (``own_size``, ``own_count``). A batch touches some files and some folders:

* a file's old size leaves its old folder and its new size comes to its new one;
* a folder that is renamed, moved, made or deleted changes its own chain of ancestors and
  those of the folders below it; what these folders held themselves leaves their old chains
  and comes to their new ones;
* all other folders pass the change of their own files up their chains.

All of it is signed rows, added up by folder (:func:`changes`). They are as many as the
touched files and the moved folders have ancestors; nothing else is read but those
folders' rows and, where a folder appears, the files that say they lie in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.operators import tree
from ledgertree.session import materialize

_KEYS = ["volume", "file_id"]
SUMS = ["size", "item_count"]
OWN = ["own_size", "own_count"]


def _direct(files: DataFrame, sign: int = 1) -> DataFrame:
    """(volume, file_id, own_size, own_count): files summed by their folder."""
    sums = files.filter("not is_directory").groupBy("volume", F.col("parent_file_id").alias("file_id"))
    return sums.agg((sign * F.coalesce(F.sum("size"), F.lit(0))).alias("own_size"), (sign * F.count("*")).alias("own_count"))


def build(facts: DataFrame, chain: DataFrame) -> DataFrame:
    """The stored table: name, sums beneath and own sums of every folder."""
    whole = tree.rollup_sizes(facts, chain)
    return whole.join(_direct(facts), _KEYS, "left").fillna(0, OWN).select(*_KEYS, "name", *SUMS, *OWN)


def _up(chain: DataFrame, held: DataFrame, sign: int = 1) -> DataFrame:
    """Signed own sums of folders, one row for each of their ancestors and themselves."""
    reach = chain.select(*_KEYS, "visited.id").join(held, _KEYS)
    return reach.select(
        "volume", F.explode("id").alias("file_id"), *[(sign * F.col(o)).alias(s) for o, s in zip(OWN, SUMS, strict=True)]
    )


def _added(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*_KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in columns])


class Change:
    """What a batch does to the table: ``sums`` to add by folder, ``own`` sums to add by
    folder, ``shape`` the folders that appear, go or get another name."""

    def __init__(self, sums: DataFrame, own: DataFrame, shape: DataFrame):
        self.sums, self.own, self.shape = sums, own, shape


def changes(
    stored: DataFrame,
    before: DataFrame,
    after: DataFrame,
    touched: DataFrame,
    chain: DataFrame,
) -> tuple[Change, DataFrame]:
    """The change a batch makes, and the chains after it.

    ``before`` and ``after`` are the facts around the batch, ``touched`` the (volume,
    file_id) of its rows, ``chain`` the chains of ``before``. Both facts are read by key.
    """
    keys = touched.select(*_KEYS).distinct()
    old = materialize(before.join(keys, _KEYS, "left_semi").withColumn("sign", F.lit(-1)), "old-rows")
    new = materialize(after.join(keys, _KEYS, "left_semi").withColumn("sign", F.lit(1)), "new-rows")

    # Folders whose own row changed, and below them all whose chain did.
    folder = ["parent_file_id", "name"]
    was = old.filter("is_directory").select(*_KEYS, F.struct(*folder).alias("was"))
    now = new.filter("is_directory").select(*_KEYS, F.struct(*folder).alias("now"))
    shape = materialize(was.join(now, _KEYS, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))), "shape")
    nodes = tree.directories(after)
    if shape.isEmpty():
        then, stale = chain, shape.select(*_KEYS)
    else:
        gone = shape.filter("now is null").select(*_KEYS)
        # Folders whose parent appears were at the end of their chain and no longer are.
        came = shape.filter("was is null").select("volume", F.col("file_id").alias("parent_file_id"))
        waiting = nodes.join(came, ["volume", "parent_file_id"], "left_semi").select(*_KEYS)
        turned = materialize(shape.select(*_KEYS).unionByName(waiting).distinct(), "turned")
        then = materialize(tree.rechain(chain, nodes, turned), "chains")
        stale = materialize(tree.below(chain, turned).unionByName(turned).distinct(), "stale").unionByName(gone).distinct()

    # Own sums: signed files by folder; a folder that appears takes the files that lie in it.
    signed = old.unionByName(new).filter("not is_directory")
    delta = signed.groupBy("volume", F.col("parent_file_id").alias("file_id")).agg(
        F.sum(F.col("sign") * F.coalesce("size", F.lit(0))).alias("own_size"), F.sum("sign").cast("long").alias("own_count")
    )
    made = shape.filter("was is null").select(*_KEYS)
    lying = after.join(made.select("volume", F.col("file_id").alias("parent_file_id")), ["volume", "parent_file_id"], "left_semi")
    own = materialize(delta.join(made, _KEYS, "left_anti").unionByName(_direct(lying)), "own-change")

    # Folders that keep their chain pass their change on; the others take all away and bring all back.
    calm = _up(then, own.join(stale, _KEYS, "left_anti"))
    held = stored.join(stale, _KEYS, "left_semi").select(*_KEYS, *OWN)
    brought = _added(held.unionByName(own.join(stale, _KEYS, "left_semi")), OWN)
    sums = _added(calm.unionByName(_up(chain, held, -1)).unionByName(_up(then, brought)), SUMS)
    return Change(materialize(sums, "sum-change"), own, shape), then


def applied(stored: DataFrame, change: Change) -> DataFrame:
    """The table after a change; folders the change does not name stay as they are."""
    shape = change.shape.select(*_KEYS, F.col("now.name").alias("new_name"), F.col("now").isNull().alias("gone"))
    added = change.sums.withColumnsRenamed({s: f"d_{s}" for s in SUMS})
    own = change.own.withColumnsRenamed({o: f"d_{o}" for o in OWN})

    def plus(name: str) -> Column:
        return (F.coalesce(name, F.lit(0)) + F.coalesce(f"d_{name}", F.lit(0))).alias(name)

    rows = stored.join(shape, _KEYS, "full_outer").filter(~F.coalesce("gone", F.lit(False)))
    rows = rows.join(added, _KEYS, "left").join(own, _KEYS, "left")
    return rows.select(*_KEYS, F.coalesce("new_name", "name").alias("name"), *map(plus, SUMS), *map(plus, OWN))
