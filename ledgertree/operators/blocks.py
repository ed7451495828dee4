"""Summaries of a log by blocks of sequences, from which net changes between any two
points are a fold over few rows.

A summary says what the rows of one file in a stretch of the log come to: enough to tell
the net change of that stretch, and enough to be put together with the summaries of the
stretches before and after it. :func:`combine` puts them together; it is associative, and a
single row is a summary too (:func:`row_summaries`), so blocks, blocks of blocks and rows
mix freely. Only the rules at the seams look at the neighbour: whether a stretch opens a
new life (the last row before it was a deletion), whether its first rename follows
another, and what had been spent before it.

A table of blocks has several levels, each ``fan`` blocks of the one below. A window of
sequences is covered by at most ``2 * (fan - 1)`` blocks of each level but the top, and by
rows of the log only where it begins and ends inside a block. A file has therefore few
rows in any window, whatever happened to it: no group needs to be split.

The name before a rename may lie arbitrarily far back, so rows carry it:
:func:`with_previous` adds it once, when rows enter the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertree.operators import bounds as B
from ledgertree.operators.ordered import CHUNK_ROWS, Ordered
from ledgertree.schema import CREATED, DELETED, MODIFIED, RENAMED
from ledgertree.session import materialize

#: Sequences in a block of the lowest level, blocks in one of the next level, and levels.
BLOCK, FAN, LEVELS = 1 << 16, 16, 4

_KEYS = ["volume", "file_id"]
#: What a summary holds besides its keys.
FIELDS = [
    "first_seq", "first_kind", "first", "last_kind", "begun", "settle", "spent", "closed",
    "turn", "created", "moved", "first_turn", "fresh",
]


def with_previous(log: DataFrame, last: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``previous`` (name, parent_file_id): where the file's row before this one had it.

    For a batch of new rows, ``last`` is the :func:`last_places` of the log before it.
    """
    place = F.struct("name", "parent_file_id")
    rows = log
    if last is not None:
        rows = log.unionByName(last.withColumn("sequence", F.lit(-1).cast("long")), allowMissingColumns=True)
    seen = Ordered(rows, _KEYS, "sequence", chunk_rows, counted=log).look_back(last={"previous": place}).df
    return seen.select(*log.columns, "previous").filter("sequence >= 0")


def last_places(log: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(volume, file_id, name, parent_file_id) of each file's last row, those in ``last`` being earlier."""
    rows = log.select(*_KEYS, "sequence", "name", "parent_file_id")
    if last is not None:
        rows = rows.unionByName(last.withColumn("sequence", F.lit(-1).cast("long")))
    found = rows.groupBy(*_KEYS).agg(F.max_by(F.struct("name", "parent_file_id"), "sequence").alias("r"))
    return found.select(*_KEYS, "r.*")


def row_summaries(rows: DataFrame) -> DataFrame:
    """Each row as the summary of itself; other columns of ``rows`` stay in front.

    ``rows`` has ``previous``. A missing size change counts as none.
    """
    seq, kind = F.col("sequence"), F.col("kind")
    delta = F.coalesce("size_delta", F.lit(0)).cast("long")
    spent = F.when(kind == RENAMED, F.lit(0)).otherwise(delta)
    turn = kind.isin(DELETED, RENAMED)
    name = F.coalesce("previous.name", F.when(F.col("previous").isNull(), F.col("name")))
    parent = F.coalesce("previous.parent_file_id", F.when(F.col("previous").isNull(), F.col("parent_file_id")))
    old = F.struct(name.alias("name"), parent.alias("parent_file_id"))
    kept = [c for c in rows.columns if c in (*_KEYS, "span", "level", "block")]
    return rows.select(
        *kept,
        seq.alias("first_seq"),
        kind.alias("first_kind"),
        F.struct("parent_file_id", "name", "is_directory", delta.alias("size_delta")).alias("first"),
        kind.alias("last_kind"),
        F.lit(None).cast("struct<seq: bigint, is_directory: boolean>").alias("begun"),
        F.lit(None).cast(
            "struct<seq: bigint, parent_file_id: bigint, name: string, is_directory: boolean, before: bigint, own: bigint>"
        ).alias("settle"),
        spent.alias("spent"),
        F.when(kind == DELETED, F.struct(seq.alias("seq"), spent.alias("upto"))).alias("closed"),
        F.when(turn, F.struct(seq.alias("seq"), kind.alias("kind"))).alias("turn"),
        F.when(kind == CREATED, seq).alias("created"),
        F.when(kind.isin(CREATED, RENAMED), F.struct(seq.alias("seq"), "parent_file_id", "name")).alias("moved"),
        F.when(turn, F.struct(seq.alias("seq"), kind.alias("kind"), old.alias("old"))).alias("first_turn"),
        F.lit(None).cast("struct<seq: bigint, old: struct<name: string, parent_file_id: bigint>>").alias("fresh"),
    )


def _settles_at(seq: Column, kind: Column, first: Column, before: Column) -> Column:
    """The point from which rows count, if the row ``first`` of kind ``kind`` is it."""
    return F.struct(
        seq.alias("seq"),
        first["parent_file_id"].alias("parent_file_id"),
        first["name"].alias("name"),
        first["is_directory"].alias("is_directory"),
        before.alias("before"),
        F.when(kind == RENAMED, first["size_delta"]).otherwise(F.lit(0)).cast("long").alias("own"),
    )


def combine(summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One summary for each key of ``by`` (default: the file) from those of consecutive stretches."""
    keys = by or _KEYS
    earlier = Window.partitionBy(*keys).orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = summaries.select(
        "*",
        F.last("last_kind").over(earlier).alias("kind_before"),
        F.last("turn.kind", ignorenulls=True).over(earlier).alias("turn_before"),
        F.coalesce(F.sum("spent").over(earlier), F.lit(0)).alias("before"),
    )
    # The seam: the first row opens a life, or the first rename follows a deletion.
    opens = F.coalesce(F.col("kind_before") == DELETED, F.lit(False))
    before, settle = F.col("before"), F.col("settle")
    inner = F.when(settle.isNotNull(), settle.withField("before", before + settle["before"]))
    at_seam = _settles_at(F.col("first_seq"), F.col("first_kind"), F.col("first"), before)
    renamed = (F.col("first_turn.kind") == RENAMED) & (F.col("turn_before") == DELETED)
    ready = seen.select(
        *keys,
        *[f for f in FIELDS if f not in ("begun", "settle", "closed", "fresh")],
        F.coalesce(
            "begun", F.when(opens, F.struct(F.col("first_seq").alias("seq"), F.col("first.is_directory").alias("is_directory")))
        ).alias("begun"),
        F.when(opens & (F.col("first_kind") != CREATED), at_seam).otherwise(inner).alias("settle"),
        F.when(
            F.col("closed").isNotNull(), F.struct(F.col("closed.seq").alias("seq"), (before + F.col("closed.upto")).alias("upto"))
        ).alias("closed"),
        F.coalesce(
            "fresh", F.when(renamed, F.struct(F.col("first_turn.seq").alias("seq"), F.col("first_turn.old").alias("old")))
        ).alias("fresh"),
    )

    def latest(name: str) -> Column:
        return F.max_by(name, F.col(f"{name}.seq")).alias(name)

    return ready.groupBy(*keys).agg(
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_kind", "first_seq").alias("first_kind"),
        F.min_by("first", "first_seq").alias("first"),
        F.max_by("last_kind", "first_seq").alias("last_kind"),
        latest("begun"),
        F.min_by("settle", F.col("settle.seq")).alias("settle"),
        F.sum("spent").alias("spent"),
        latest("closed"),
        latest("turn"),
        F.max("created").alias("created"),
        latest("moved"),
        F.min_by("first_turn", F.col("first_turn.seq")).alias("first_turn"),
        latest("fresh"),
    )


def net(summaries: DataFrame) -> DataFrame:
    """Net change of each file from the summary of a whole window.

    A file that the window's first row does not create existed before: all its rows count.
    Otherwise rows count from the first life that does not begin with a creation; without
    one only the last life counts, while it has not ended.
    """
    first = _settles_at(F.col("first_seq"), F.col("first_kind"), F.col("first"), F.lit(0).cast("long"))
    point = F.when(F.col("first_kind") != CREATED, first).otherwise(F.col("settle"))
    found = summaries.withColumn("point", point)
    settled, since = F.col("point").isNotNull(), F.col("point.seq")
    turn = F.when(F.col("turn.seq") >= since, F.col("turn.kind"))
    kind = (
        F.when(~settled, F.when(F.col("last_kind") != DELETED, F.lit(CREATED)))
        .when(turn.isNull(), F.lit(MODIFIED))
        .when(turn == RENAMED, F.lit(RENAMED))
        .when(F.col("created") > F.col("turn.seq"), F.lit(MODIFIED))
        .otherwise(F.lit(DELETED))
    )
    delta = F.when(settled, F.col("spent") - F.col("point.before") + F.col("point.own")).otherwise(
        F.col("spent") - F.coalesce("closed.upto", F.lit(0))
    )
    # The window's first turn has none before it.
    opening = F.when(F.col("first_turn.kind") == RENAMED, F.struct(F.col("first_turn.seq").alias("seq"), F.col("first_turn.old").alias("old")))
    found = found.withColumn("renamed", F.coalesce("fresh", opening))
    old = F.when(F.col("renamed.seq") >= since, F.col("renamed.old"))
    at_point = settled & (F.col("moved").isNull() | (F.col("moved.seq") < since))
    return found.select(
        *_KEYS,
        *[F.when(at_point, F.col(f"point.{c}")).otherwise(F.col(f"moved.{c}")).alias(c) for c in ("parent_file_id", "name")],
        F.when(settled, F.col("point.is_directory"))
        .when(F.col("begun").isNotNull(), F.col("begun.is_directory"))
        .otherwise(F.col("first.is_directory"))
        .alias("is_directory"),
        delta.cast("long").alias("size_delta"),
        kind.alias("kind"),
        old["name"].alias("old_name"),
        old["parent_file_id"].alias("old_parent_file_id"),
    ).filter("kind is not null")


# --- tables of blocks ----------------------------------------------------------------------


class Blocks:
    """``table``: summaries by (volume, level, block, file); ``ends``: first sequence of each
    volume that no block covers; and the sizes they were made with."""

    def __init__(self, table: DataFrame, ends: DataFrame, block: int = BLOCK, fan: int = FAN, levels: int = LEVELS):
        self.table, self.ends = table, ends
        self.block, self.fan, self.levels = block, fan, levels


def block_ends(stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """(volume, built_to): end of the last block that the log is past; ``stats`` as of ``bounds.log_stats``."""
    return stats.selectExpr("volume", f"(max_sequence + 1) div {block} * {block} as built_to")


def build(
    log: DataFrame,
    stats: DataFrame,
    known: Blocks | None = None,
    block: int = BLOCK,
    fan: int = FAN,
    levels: int = LEVELS,
) -> Blocks:
    """Summaries of all whole blocks of ``log``, which has ``previous``.

    With ``known``, its blocks are kept and only newer ones are made: from log rows past its
    ends, and from blocks of the level below. The table is written in stretches of the log,
    each of them in order of volume, level, block and file.
    """
    if known is not None:
        block, fan, levels = known.block, known.fan, known.levels
    ends = block_ends(stats, block)
    if known is None:
        ends = ends.withColumn("done_to", F.lit(0).cast("long"))
    else:
        ends = ends.join(known.ends.withColumnRenamed("built_to", "done_to"), "volume", "left").fillna(0, ["done_to"])
    ends = materialize(ends, "block-ends")
    fresh = ends.selectExpr("volume", "done_to - 1 as start_seq", "built_to - 1 as end_seq")
    columns = ["volume", "level", "block", "file_id", *FIELDS]
    order = ["volume", "level", "block", "file_id"]
    # Levels made from the rows themselves: as long as a block's rows fit one task.
    lowest = 1
    while known is None and lowest < levels and block * fan**lowest <= CHUNK_ROWS:
        lowest += 1
    made = [materialize(_lowest(B.in_window(log, fresh), ends, block, fan, lowest).select(*columns).sortWithinPartitions(*order), "blocks")]
    for level in range(lowest, levels):
        below = made[-1].filter(F.col("level") == level - 1)
        if known is not None:
            below = below.unionByName(known.table.filter(F.col("level") == level - 1).select(*columns))
        above = below.drop("level").withColumn("block", F.expr(f"block div {fan}")).join(ends, "volume")
        end = (F.col("block") + 1) * block * fan**level
        whole = above.filter((end <= F.col("built_to")) & (end > F.col("done_to")))
        summaries = combine(whole, [*_KEYS, "block"]).withColumn("level", F.lit(level))
        made.append(materialize(summaries.select(*columns), "blocks"))
    if known is not None:
        made.insert(0, known.table.select(*columns))
    table = made[0]
    for more in made[1:]:
        table = table.unionByName(more)
    return Blocks(table, ends.select("volume", "built_to"), block, fan, levels)


def _lowest(rows: DataFrame, ends: DataFrame, block: int, fan: int, levels: int) -> DataFrame:
    """Summaries of the whole blocks of the lowest ``levels``, all from one pass over the rows.

    The log rows, which are much smaller than summaries, move once: to stretches of the log
    as long as a block of the highest of these levels, in which every block of them ends.
    """
    span = block * fan ** (levels - 1)
    needed = ["volume", "file_id", "sequence", "kind", "parent_file_id", "name", "is_directory", "size_delta", "previous"]
    ended = rows.join(ends.select("volume", "built_to"), "volume")
    moved = ended.select(*needed, "built_to", F.expr(f"sequence div {span}").alias("span")).repartitionByRange("volume", "span")
    held = [
        F.struct(F.lit(level).alias("level"), F.expr(f"sequence div {block * fan**level}").alias("block"))
        for level in range(levels)
    ]
    each = moved.select("*", F.inline(F.array(*held)))
    size = F.lit(block) * F.pow(F.lit(fan), F.col("level")).cast("long")
    each = each.filter((F.col("block") + 1) * size <= F.col("built_to"))
    return combine(row_summaries(each), [*_KEYS, "span", "level", "block"])


def cover(bounds: DataFrame | B.Windows, blocks: Blocks) -> DataFrame:
    """The windows with the ranges [lo, hi) of blocks of each level that lie inside them.

    A level's blocks are used where no block of the next level is.
    """
    ends = blocks.ends.select("volume", "built_to")
    table = B.windows(bounds).table.join(ends, "volume", "left").fillna(0, ["built_to"])
    table = table.withColumn("lo_0", F.expr(f"(start_seq + {blocks.block}) div {blocks.block}"))
    table = table.withColumn("hi_0", F.expr(f"greatest(lo_0, least(end_seq + 1, built_to) div {blocks.block})"))
    for level in range(1, blocks.levels):
        table = table.withColumn(f"lo_{level}", F.expr(f"(lo_{level - 1} + {blocks.fan - 1}) div {blocks.fan}"))
        table = table.withColumn(f"hi_{level}", F.expr(f"greatest(lo_{level}, hi_{level - 1} div {blocks.fan})"))
    return table.drop("built_to")


def _at_ends(blocks: Blocks, get) -> Column:
    """Log rows of a window that no block holds; ``get`` gives a column of :func:`cover`."""
    seq = F.col("sequence")
    outside = (seq < get("lo_0") * blocks.block) | (seq >= get("hi_0") * blocks.block)
    return (seq > get("start_seq")) & (seq <= get("end_seq")) & outside


def _inside(blocks: Blocks, get) -> Column:
    """Blocks that cover a window."""
    out = F.lit(False)
    for level in range(blocks.levels):
        block = F.col("block")
        here = (F.col("level") == level) & (block >= get(f"lo_{level}")) & (block < get(f"hi_{level}"))
        if level + 1 < blocks.levels:
            here &= (block < get(f"lo_{level + 1}") * blocks.fan) | (block >= get(f"hi_{level + 1}") * blocks.fan)
        out |= here
    return out


def window_summaries(log: DataFrame, blocks: Blocks, bounds: DataFrame | B.Windows) -> DataFrame:
    """Summaries that together cover the windows: blocks, and single rows at the ends.

    Few windows become literal predicates, which prune folders and row groups of both
    tables; more are joined.
    """
    ranges = cover(bounds, blocks)
    rows = B.few(ranges)
    if rows is None:
        ranges = materialize(ranges, "ranges")

        def among(df: DataFrame, test) -> DataFrame:
            return df.join(ranges, "volume").filter(test(blocks, F.col)).select(*df.columns)
    else:

        def among(df: DataFrame, test) -> DataFrame:
            condition = F.lit(False)
            for row in rows:
                condition |= (F.col("volume") == row.volume) & test(blocks, lambda name, row=row: F.lit(row[name]))
            return df.filter(condition)

    single = row_summaries(among(log, _at_ends)).select(*_KEYS, *FIELDS)
    return single.unionByName(among(blocks.table, _inside).select(*_KEYS, *FIELDS))


def net_changes(log: DataFrame, blocks: Blocks, bounds: DataFrame | B.Windows) -> DataFrame:
    """What :func:`snapshots.net_changes` gives, from blocks; ``log`` has ``previous``."""
    return net(combine(window_summaries(log, blocks, bounds)))
