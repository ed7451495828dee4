"""Inputs several queries share, and the matching named subqueries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ledgertree.operators import blocks, bounds, intervals, replay, search, snapshots, token_index, tree
from ledgertree.plans.fixtures import NOW, Fixtures
from ledgertree.plans.registry import part
from ledgertree.schema import PARENT_SNAPSHOTS, VOLUME_STATES

NOW_AT = datetime.fromisoformat(NOW)
SINCE = datetime(2024, 1, 15)


def facts(fx: Fixtures) -> DataFrame:
    return fx.table("fx_facts")


def raw_log(fx: Fixtures) -> DataFrame:
    return fx.table("fx_log")


def log(fx: Fixtures) -> DataFrame:
    """The log with corrected change sizes."""
    return fx.keep(
        "log", lambda: replay.correct_deltas(facts(fx), raw_log(fx)), ("volume", "sequence")
    )


#: Sequences in a block; the tables here are small.
BLOCK, FAN, LEVELS = 256, 8, 3


def placed_log(fx: Fixtures) -> DataFrame:
    """The log whose rows know where the row before had the file."""
    return fx.keep("placed-log", lambda: blocks.with_previous(log(fx)), ("volume", "sequence"))


def log_blocks(fx: Fixtures) -> blocks.Blocks:
    def table() -> DataFrame:
        return blocks.build(placed_log(fx), log_stats(fx), None, BLOCK, FAN, LEVELS).table

    made = fx.hold("log-blocks", table)
    ends = fx.keep("block-ends", lambda: blocks.block_ends(log_stats(fx), BLOCK))
    return blocks.Blocks(made, ends, BLOCK, FAN, LEVELS)


def chain(fx: Fixtures) -> DataFrame:
    return fx.keep("chain", lambda: tree.chains(tree.directories(facts(fx))))


def folder_numbers(fx: Fixtures) -> DataFrame:
    return fx.keep("folder-numbers", lambda: intervals.labels(chain(fx)), ("volume", "enter"))


def labelled_facts(fx: Fixtures) -> DataFrame:
    return fx.keep("labelled-facts", lambda: intervals.labelled(facts(fx), folder_numbers(fx)), ("volume", "at"))


def replayed(fx: Fixtures) -> DataFrame:
    return fx.stored("replayed", lambda: replay.replay(facts(fx), raw_log(fx)), ("volume", "file_id"))


def log_end(fx: Fixtures) -> int:
    return raw_log(fx).agg(F.max("sequence")).first()[0]


def start_cursors(fx: Fixtures) -> DataFrame:
    """A position in the middle of the log for each volume."""
    half = log_end(fx) // 2
    return raw_log(fx).filter(F.col("sequence") <= half).groupBy("volume").agg(F.max("sequence").alias("last_sequence"))


def log_stats(fx: Fixtures) -> DataFrame:
    return fx.keep("log-stats", lambda: bounds.log_stats(log(fx)))


# (id, label, taken at, tenths of the log)
SNAPSHOTS = [
    ("s_a", "a", datetime(2024, 1, 10), 3),
    ("s_b", "b", datetime(2024, 1, 21), 7),
    ("s_c", "auto_c", datetime(2024, 1, 28), 9),
]


def snapshot_tables(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    def build(which: int) -> DataFrame:
        parents, children = fx.spark.createDataFrame([], PARENT_SNAPSHOTS), None
        for sid, label, at, tenths in SNAPSHOTS:
            seen = log(fx).filter(F.col("sequence") <= log_end(fx) * tenths // 10)
            p, c = snapshots.create_snapshot(seen, facts(fx), parents, at, label, snapshot_id=sid)
            parents = parents.unionByName(p)
            children = c if children is None else children.unionByName(c)
        return (parents, children)[which]

    return fx.keep("parents", lambda: build(0)), fx.keep("children", lambda: build(1))


def window_ab(fx: Fixtures) -> DataFrame:
    return bounds.bounds_between(snapshot_tables(fx)[1], "s_a", "s_b")


def states(fx: Fixtures) -> DataFrame:
    """Volume states: the last volume is still being reconciled."""
    vols = facts(fx).select("volume").distinct()
    late = F.col("volume") == "G:"
    return vols.select(
        "volume", F.when(late, F.lit("Reconciling")).otherwise(F.lit("Live")).alias("state"), late.alias("replaying")
    ).to(VOLUME_STATES)


def documents(fx: Fixtures) -> DataFrame:
    return fx.keep("documents", lambda: search.build_documents(facts(fx), chain(fx)))


def names(fx: Fixtures) -> DataFrame:
    """Documents of the named parts."""
    base = fx.table("fx_names").select(
        "volume", "file_id", F.lit(0).cast("long").alias("parent_file_id"), "name",
        F.lit(False).alias("is_directory"), "size",
        F.lit(NOW_AT).alias("created_at"), F.lit(NOW_AT).alias("modified_at"), "attributes",
    )
    return fx.keep("names", lambda: search.build_documents(base, chain(fx)))


def token_index_of(fx: Fixtures) -> token_index.TokenIndex:
    """The token tables of :func:`names`."""
    made: dict[str, DataFrame] = {}
    build = {
        "postings": lambda: token_index.postings_of(names(fx)),
        "tokens": lambda: token_index.tokens_of(made["postings"]),
        "grams": lambda: token_index.grams_of(made["tokens"]),
        "deletions": lambda: token_index.deletions_of(made["tokens"]),
        "name_grams": lambda: search.gram_table(names(fx)),
    }
    for name, table in build.items():
        # A token is looked up by value; the other tables are pruned by the pages of each file.
        store = fx.keep if name == "tokens" else fx.stored
        made[name] = store(f"names-{name}", table, token_index.LAYOUT[name])
    return token_index.TokenIndex(**made)


# --- the same in SQL ------------------------------------------------------------------------

part("log_end", "", "select max(sequence) as m from fx_log")

# Each directory with its ancestors, itself at depth 0.
part("up", "(volume, file_id, node, name, nxt, depth)", """
 select volume, file_id, file_id, name,
        case when parent_file_id <> file_id and parent_file_id <> 0 then parent_file_id end, 0
 from fx_facts where is_directory
 union all
 select u.volume, u.file_id, d.file_id, d.name,
        case when d.parent_file_id <> d.file_id and d.parent_file_id <> 0 then d.parent_file_id end, u.depth + 1
 from up u join fx_facts d on d.volume = u.volume and d.file_id = u.nxt and d.is_directory""")

part("dirpath", "", """
 select volume, file_id,
        coalesce(string_agg(name, '/' order by depth desc) filter (where name <> volume), '') as dir_path
 from up group by volume, file_id""")

part("logc", "", """
 select sequence, volume, file_id, parent_file_id, name, kind, is_directory, "at", source,
        cast(case when kind = 'Deleted' then -prev else eff - prev end as bigint) as size_delta
 from (select l.*, case when kind = 'Deleted' then 0 else greatest(observed_size, 0) end as eff,
              coalesce(lag(case when kind = 'Deleted' then 0 else greatest(observed_size, 0) end)
                         over (partition by l.volume, l.file_id order by sequence), f.size, 0) as prev
       from fx_log l left join fx_facts f on f.volume = l.volume and f.file_id = l.file_id
       where kind <> 'Renamed') c
 union all
 select sequence, volume, file_id, parent_file_id, name, kind, is_directory, "at", source, cast(0 as bigint)
 from fx_log where kind = 'Renamed'""")


def fold_parts(prefix: str, facts_from: str, log_from: str) -> None:
    """Row-by-row replay of a log over facts as the named subquery ``<prefix>``."""
    part(f"{prefix}_rows", "", f"""
 select volume, file_id, -1 as sequence, 'Baseline' as kind, parent_file_id, name, is_directory, size,
        created_at, modified_at, attributes, 0 as pos from {facts_from}
 union all
 select volume, file_id, sequence, kind, parent_file_id, name, is_directory, greatest(observed_size, 0), "at", "at", 0,
        row_number() over (partition by volume, file_id order by sequence) from {log_from}""")
    part(f"{prefix}_steps", "", f"""
 select *, row_number() over (partition by volume, file_id order by pos) as step from {prefix}_rows""")
    part(f"{prefix}_fold", "(volume, file_id, step, alive, parent_file_id, name, is_directory, size, created_at, modified_at, attributes)", f"""
 select volume, file_id, step, kind in ('Baseline', 'Created', 'Modified'), parent_file_id, name, is_directory, size,
        created_at, modified_at, attributes from {prefix}_steps where step = 1
 union all
 select s.volume, s.file_id, s.step,
        case when s.kind in ('Created', 'Modified') then true when s.kind = 'Deleted' then false else f.alive end,
        case when s.kind <> 'Deleted' then s.parent_file_id else f.parent_file_id end,
        case when s.kind <> 'Deleted' then s.name else f.name end,
        case when s.kind in ('Created', 'Modified') then s.is_directory else f.is_directory end,
        case when s.kind in ('Created', 'Modified') then s.size else f.size end,
        case when s.kind in ('Created', 'Modified') and not f.alive then s.created_at else f.created_at end,
        case when s.kind in ('Created', 'Modified') then s.modified_at else f.modified_at end,
        case when s.kind in ('Created', 'Modified') then s.attributes else f.attributes end
 from {prefix}_fold f join {prefix}_steps s on s.volume = f.volume and s.file_id = f.file_id and s.step = f.step + 1""")
    part(prefix, "", f"""
 select volume, file_id, arg_max(parent_file_id, step) as parent_file_id, arg_max(name, step) as name,
        arg_max(is_directory, step) as is_directory, cast(arg_max(size, step) as bigint) as size,
        arg_max(created_at, step) as created_at, arg_max(modified_at, step) as modified_at,
        arg_max(attributes, step) as attributes
 from {prefix}_fold group by volume, file_id having arg_max(alive, step)""")


part("cur", "", """
 select volume, max(sequence) as last_sequence from fx_log
 where sequence <= (select m // 2 from log_end) group by volume""")
part("log_head", "", "select l.* from fx_log l join cur c on c.volume = l.volume where l.sequence <= c.last_sequence")
part("log_tail", "", "select l.* from fx_log l join cur c on c.volume = l.volume where l.sequence > c.last_sequence")
fold_parts("replayed", "fx_facts", "fx_log")
fold_parts("at_half", "fx_facts", "log_head")
fold_parts("from_half", "fx_facts", "log_tail")

part("children", "", """
 select s.parent_id, l.volume, max(l.sequence) as sequence_number, max(f.n) as facts_count
 from (values ('s_a', 3), ('s_b', 7), ('s_c', 9)) s(parent_id, tenths)
 join fx_log l on l.sequence <= (select m * s.tenths // 10 from log_end)
 join (select volume, count(*) as n from fx_facts group by volume) f on f.volume = l.volume
 group by s.parent_id, l.volume""")
part("parents", "", """
 select * from (values ('s_a', 'a', timestamp '2024-01-10 00:00:00'), ('s_b', 'b', timestamp '2024-01-21 00:00:00'),
   ('s_c', 'auto_c', timestamp '2024-01-28 00:00:00')) p(id, label, created_at)""")
part("win", "", """
 select a.volume, least(a.sequence_number, b.sequence_number) as lo, greatest(a.sequence_number, b.sequence_number) as hi
 from children a join children b on a.volume = b.volume and a.parent_id = 's_a' and b.parent_id = 's_b'""")
part("logw", "", """
 select l.* from logc l join win w on w.volume = l.volume and l.sequence > w.lo and l.sequence <= w.hi""")
