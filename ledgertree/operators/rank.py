"""Rankings: largest, fastest-growing and most-changed files and folders."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.functions.display import exact_delta, human_delta, human_size
from ledgertree.operators import bounds as B
from ledgertree.operators import intervals, tree
from ledgertree.session import materialize

DEFAULT_LIMIT = 20
# Growth below this many bytes is noise.
MIN_GROWTH = 2

RANKED = [
    "volume", "file_id", "parent_file_id", "name", "is_directory", "size", "size_delta", "churn", "item_count", "value",
]


def _ranked(df: DataFrame, value: Column, **missing: Column) -> DataFrame:
    for name, expr in missing.items():
        df = df.withColumn(name, expr)
    return df.withColumn("value", value.cast("long")).select(*RANKED)


def rank_key() -> Column:
    """Full sort key, ascending: value desc, name, id desc, volume."""
    return F.struct(
        (-F.col("value")).alias("v"), F.col("name").alias("n"), (-F.col("file_id")).alias("f"), F.col("volume").alias("o")
    )


def files_by_size(facts: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _ranked(
        facts.filter("not is_directory"), F.col("size"), size_delta=zero, churn=zero, item_count=zero
    )


def folders_by_size(facts: DataFrame, chain: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _ranked(
        tree.rollup_sizes(facts, chain),
        F.col("size"),
        parent_file_id=F.lit(None).cast("long"),
        is_directory=F.lit(True),
        size_delta=zero,
        churn=zero,
    )


def changed_items(log: DataFrame) -> DataFrame:
    """One row per item of an already windowed log: Σ change, rows, latest name and place.

    All aggregates combine on the map side, so an item with very many rows costs
    one partial row per task.
    """
    return (
        log.groupBy("volume", "file_id")
        .agg(
            F.sum("size_delta").alias("size_delta"),
            F.count("*").alias("churn"),
            F.max_by(F.struct("parent_file_id", "name", "is_directory"), "sequence").alias("l"),
        )
        .select("volume", "file_id", "l.*", "size_delta", "churn")
    )


def _visible(churn: bool) -> Column:
    some = (F.col("size_delta") != 0) | (F.col("churn") != 0)
    if churn:
        return some
    return some & ((F.col("size_delta") == 0) | (F.abs("size_delta") >= MIN_GROWTH))


def _change_value(churn: bool) -> Column:
    return F.col("churn") if churn else F.abs("size_delta")


def files_by_change(items: DataFrame, churn: bool = False) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _ranked(
        items.filter("not is_directory").filter(_visible(churn)), _change_value(churn), size=zero, item_count=zero
    )


def change_nodes(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Directories as the window leaves them.

    A directory with log rows takes the parent and name of its latest row.
    """
    moved = items.filter("is_directory").select("volume", "file_id", "parent_file_id", "name")
    stale = tree.directories(facts).join(
        items.select("volume", "file_id"), ["volume", "file_id"], "left_anti"
    )
    return stale.unionByName(moved)


def change_chains(facts: DataFrame, items: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Chains over those; of ``chain``, that of ``facts``, all that lead past no changed folder serve."""
    nodes = change_nodes(facts, items)
    if chain is None:
        return tree.chains(nodes)
    moved = items.filter("is_directory").select("volume", "file_id")
    return chain if moved.isEmpty() else tree.rechain(chain, nodes, moved)


def folders_by_change(items: DataFrame, chain: DataFrame, churn: bool = False) -> DataFrame:
    return _ranked(
        tree.rollup_changes(items, chain).filter(_visible(churn)),
        _change_value(churn),
        parent_file_id=F.lit(None).cast("long"),
        is_directory=F.lit(True),
        size=F.lit(0).cast("long"),
    )


def inside(ranked: DataFrame, chain: DataFrame, volume: str, root_id: int) -> DataFrame:
    """Ranked folders strictly below a folder."""
    below = chain.filter(
        (F.col("volume") == volume)
        & (F.col("file_id") != root_id)
        & F.exists("visited", lambda a: a["id"] == F.lit(root_id))
    ).select("volume", "file_id")
    return ranked.filter(F.col("volume") == volume).join(below, ["volume", "file_id"], "left_semi")


def suppress_nested(ranked: DataFrame, chain: DataFrame) -> DataFrame:
    """Keep a folder only when none of its ancestors ranks before it.

    This equals walking down the ranking and skipping folders under one already
    taken: an ancestor that was skipped lies under a taken one itself, which is
    then an ancestor here too. It needs no global order.
    """
    keyed = materialize(ranked.withColumn("key", rank_key()), "ranked")
    ups = chain.select(
        "volume", "file_id", F.explode(F.slice("visited", F.lit(2), F.size("visited"))).alias("a")
    ).select("volume", "file_id", F.col("a.id").alias("up"))
    best = (
        ups.join(keyed.select("volume", F.col("file_id").alias("up"), "key"), ["volume", "up"])
        .groupBy("volume", "file_id")
        .agg(F.min("key").alias("above"))
    )
    return (
        keyed.join(best, ["volume", "file_id"], "left")
        .filter("above is null or key < above")
        .select(*ranked.columns)
    )


def encode_cursor(row) -> str:
    """Cursor after a shown row: its whole sort key."""
    return base64.b64encode(
        json.dumps([row["value"], row["name"], row["file_id"], row["volume"]]).encode()
    ).decode()


def page(ranked: DataFrame, limit: int = DEFAULT_LIMIT, cursor: str | None = None) -> DataFrame:
    """The next ``limit`` rows of a ranking, with the cursor that follows each row."""
    if cursor is not None:
        value, name, file_id, volume = json.loads(base64.b64decode(cursor))
        after = F.struct(
            F.lit(-value).cast("long").alias("v"), F.lit(name).alias("n"), F.lit(-file_id).cast("long").alias("f"), F.lit(volume).alias("o")
        )
        ranked = ranked.filter(rank_key() > after)
    return ranked.orderBy(F.desc("value"), "name", F.desc("file_id"), "volume").limit(limit)


def with_parent_path(ranked: DataFrame, chain: DataFrame) -> DataFrame:
    """Add ``path``: the folders above the item, below the volume.

    Only the chains of the page's own folders are made into paths; the page is the
    side that may be broadcast.
    """
    placed = ranked.withColumn("_dir", F.coalesce("parent_file_id", "file_id"))
    wanted = placed.select("volume", F.col("_dir").alias("file_id")).distinct()
    paths = tree.directory_paths(chain.join(wanted, ["volume", "file_id"]))
    joined = placed.join(paths.withColumnRenamed("file_id", "_dir"), ["volume", "_dir"], "left")
    whole = F.coalesce("dir_path", F.lit(""))
    above = F.when(
        F.col("parent_file_id").isNull(),
        F.when(F.instr(whole, "/") > 0, F.regexp_replace(whole, "/[^/]*$", "")).otherwise(F.lit("")),
    ).otherwise(whole)
    return joined.select(*ranked.columns, above.alias("path"))


def top(
    facts: DataFrame,
    log: DataFrame | None = None,
    volume_snapshots: DataFrame | None = None,
    *,
    folders: bool = False,
    files: bool = False,
    growth: bool = False,
    churn: bool = False,
    since: datetime | None = None,
    between: tuple[str, str] | None = None,
    within: tuple[str, int] | None = None,
    below_roots: bool = False,
    limit: int = DEFAULT_LIMIT,
    cursor: str | None = None,
    now: datetime | None = None,
    chain: DataFrame | None = None,
    stats: DataFrame | None = None,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """One ranking, as a page with paths.

    ``within`` is the (volume, folder id) to look below; ``below_roots`` looks below
    the top folder of every volume, so that folders rank beside those of other
    volumes instead of vanishing under their root. With ``since`` or
    ``between`` (two snapshot ids) the ranking is by change, of folders unless
    ``files`` is set; otherwise it is by current size, of files unless
    ``folders`` is set. ``chain`` saves computing the folder chains of ``facts`` when
    the caller keeps them, and ``stats``, see ``bounds.log_stats``, the passes for ends of the log.
    With ``numbers``, the labels of ``chain``, and ``facts`` stored by them (``intervals.labelled``),
    a ranking by size ``within`` a folder reads the range of facts below it only.
    """
    if since is not None and between is not None:
        raise ValueError("since and between are mutually exclusive")
    if growth and churn:
        raise ValueError("growth and churn are mutually exclusive")
    if folders and files:
        raise ValueError("folders and files are mutually exclusive")
    interval = since is not None or between is not None
    by_folder = folders or (interval and not files)
    if within is not None:
        facts = facts.filter(F.col("volume") == within[0])
        log = log.filter(F.col("volume") == within[0]) if log is not None else None
        stats = stats.filter(F.col("volume") == within[0]) if stats is not None else None

    items = None
    if interval:
        if since is not None:
            if now is not None:
                B.check_history(log, since, now, stats)
            window = B.windows(B.bounds_since(log, since, stats))
        else:
            window = B.windows(B.bounds_between(volume_snapshots, *between))
            B.check_window(log, window, stats)
        items = materialize(changed_items(B.in_window(log, window)), "items")
    if interval:
        chain = change_chains(facts, items, chain)
    elif chain is None:
        chain = tree.chains(tree.directories(facts))
    whole = chain
    if within is not None and numbers is not None and not interval:
        below = intervals.folders_below(numbers, *within)
        facts = intervals.subtree(facts, numbers, chain, *within)
        if below is not None:
            chain = chain.join(below, ["volume", "file_id"], "left_semi")
    if interval:
        ranked = folders_by_change(items, chain, churn) if by_folder else files_by_change(items, churn)
    else:
        ranked = folders_by_size(facts, chain) if by_folder else files_by_size(facts)
    if within is not None:
        ranked = inside(ranked, chain, *within) if by_folder else tree.subtree(ranked, whole, *within)
    if below_roots and by_folder:
        roots = chain.filter(F.col("visited")[0]["top"]).select("volume", "file_id")
        ranked = ranked.join(roots, ["volume", "file_id"], "left_anti")
    if by_folder:
        ranked = suppress_nested(ranked, chain)
    shown = page(ranked, limit, cursor)
    return with_parent_path(shown, whole)


def ranking_report(
    ranked: DataFrame, mode: str = "size", window: tuple[str, str] | None = None
) -> DataFrame:
    """Text columns of a ranking page; ``mode`` is size, growth or churn."""
    # "path" holds the folders above; the report shows the item's own place.
    parts = F.filter(F.array("volume", "path"), lambda s: s != "")
    measure = {
        "size": (human_size(F.col("size")), F.concat(F.col("size").cast("string"), F.lit(" B"))),
        "growth": (human_delta(F.col("size_delta")), exact_delta(F.col("size_delta"))),
        "churn": (F.col("churn").cast("string"), F.lit("")),
    }[mode]
    span = F.lit("-") if window is None else F.lit(f"[{window[0]}..{window[1]}]")
    return ranked.select(
        "volume",
        "file_id",
        "name",
        measure[0].alias("measure"),
        measure[1].alias("exact"),
        F.when(F.col("is_directory"), F.lit("Folder")).otherwise(F.lit("File")).alias("type"),
        F.array_join(parts, "/").alias("full_path"),
        F.when(F.col("is_directory"), F.col("item_count").cast("string")).otherwise(F.lit("-")).alias("items"),
        span.alias("bounds"),
    )
