"""Differences and path lookups over logs that move, delete and create folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertree.operators import blocks, bounds, replay, rollup, snapshots, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.log_queries import _SHOWN
from ledgertree.plans.registry import part, query
from ledgertree.plans.tree_queries import moved_log


def _placed(fx: Fixtures) -> DataFrame:
    return fx.keep("moved-placed", lambda: blocks.with_previous(moved_log(fx)), ("volume", "sequence"))


def _blocks(fx: Fixtures) -> blocks.Blocks:
    stats = bounds.log_stats(_placed(fx))

    def table() -> DataFrame:
        return blocks.build(_placed(fx), stats, None, S.BLOCK, S.FAN, S.LEVELS).table

    made = fx.hold("moved-blocks", table)
    return blocks.Blocks(made, fx.keep("moved-ends", lambda: blocks.block_ends(stats, S.BLOCK)), S.BLOCK, S.FAN, S.LEVELS)


def _folder_rows(fx: Fixtures) -> DataFrame:
    return moved_log(fx).filter("is_directory").withColumn("observed_size", F.lit(0).cast("long"))


def _facts(fx: Fixtures) -> DataFrame:
    """Facts after the folder rows, before all others."""
    return fx.keep("moved-facts", lambda: replay.replay(S.facts(fx), _folder_rows(fx)))


def _chain(fx: Fixtures) -> DataFrame:
    moved = _folder_rows(fx).select("volume", "file_id")
    return fx.keep("moved-chain", lambda: tree.rechain(S.chain(fx), tree.directories(_facts(fx)), moved))


def _replayed(fx: Fixtures) -> DataFrame:
    """Facts after all rows: the folder rows touch no file, and the others no folder."""
    files = S.replayed(fx).filter("not is_directory")
    return fx.keep("moved-replayed", lambda: files.unionByName(_facts(fx).filter("is_directory")))


part("dirpath_m", "", """
 select volume, file_id,
        coalesce(string_agg(name, '/' order by depth desc) filter (where name <> volume), '') as dir_path
 from up_m group by volume, file_id""")
part("net_m", "", """
 select volume, file_id, parent_file_id, name, is_directory, size_delta, kind from net
 union all
 select m.volume, file_id, parent_file_id, name, true, cast(0 as bigint), kind from moves m join win w on w.volume = m.volume""")
part("net_paths_m", "", f"""
 select n.*, n.volume || case when coalesce(d.dir_path, '') = '' then '' else '/' || d.dir_path end || '/' || n.name as path
 from net_m n left join (select volume as v, file_id as parent, dir_path from dirpath_m) d on d.v = n.volume and d.parent = n.parent_file_id
 where {_SHOWN}""")


@query("snapshot_diff_moved", "select volume, file_id, parent_file_id, name, is_directory, size_delta, kind, path from net_paths_m")
def snapshot_diff_moved(fx: Fixtures):
    """Folders are renamed, created and deleted in the window; deleted ones are known from the log alone."""
    found = snapshots.snapshot_diff(
        _placed(fx), _facts(fx), *S.snapshot_tables(fx), "a", "b",
        chain=_chain(fx), stats=S.log_stats(fx), blocks=_blocks(fx),
    )
    return found.drop("old_name", "old_parent_file_id")


part("log_paths_m", "", """
 select l.volume, l.file_id, l.sequence, concat_ws('/', l.volume, nullif(d.dir_path, ''), l.name) as path
 from fx_log l join dirpath_m d on d.volume = l.volume and d.file_id = l.parent_file_id""")
part("live_paths_m", "", """
 select concat_ws('/', f.volume, nullif(d.dir_path, ''), f.name) as path, min(f.file_id) as file_id
 from replayed f join dirpath_m d on d.volume = f.volume and d.file_id = f.parent_file_id
 where not exists (select 1 from moves m where m.volume = f.volume and m.file_id = f.parent_file_id and m.kind = 'Deleted')
 group by 1""")


@query("path_to_id_moved", """
select p.path, p.volume, coalesce(v.file_id, p.log_id) as file_id,
       case when v.file_id is null then 'log' else 'facts' end as found_in
from (select path, volume, arg_max(file_id, sequence) as log_id from log_paths_m group by path, volume) p
left join live_paths_m v on v.path = p.path""")
def path_to_id_moved(fx: Fixtures):
    """Every path that the moved, new and deleted folders give the log's files."""
    facts = _replayed(fx)
    parents = S.raw_log(fx).select("volume", F.col("parent_file_id").alias("file_id"))
    known = tree.known_chains(parents, facts, moved_log(fx), _chain(fx))
    dirs = tree.directory_paths(known).withColumnRenamed("file_id", "parent_file_id")
    folder = F.when(F.col("dir_path") != "", F.col("dir_path"))
    asked = S.raw_log(fx).join(dirs, ["volume", "parent_file_id"]).select(F.concat_ws("/", "volume", folder, "name").alias("path"))
    return tree.lookup_paths(asked, facts, _chain(fx), moved_log(fx))


part("nodes_l", "", """
 select * from nodes_m n where not exists (
   select 1 from moves m where m.volume = n.volume and m.file_id = n.file_id and m.kind = 'Deleted')""")
part("up_l", "(volume, file_id, node, name, nxt, depth)", """
 select volume, file_id, file_id, name,
        case when parent_file_id <> file_id and parent_file_id <> 0 then parent_file_id end, 0 from nodes_l
 union all
 select u.volume, u.file_id, d.file_id, d.name,
        case when d.parent_file_id <> d.file_id and d.parent_file_id <> 0 then d.parent_file_id end, u.depth + 1
 from up_l u join nodes_l d on d.volume = u.volume and d.file_id = u.nxt""")
part("sizes_l", "", """
 select volume, parent_file_id, sum(size) as size, count(*) as n from replayed where not is_directory
 group by volume, parent_file_id""")


@query("folder_rollup_maintained", """
select u.volume, u.node as file_id, max(u.name) as name, cast(coalesce(sum(s.size), 0) as bigint) as size,
       cast(coalesce(sum(s.n), 0) as bigint) as item_count
from up_l u left join sizes_l s on s.volume = u.volume and s.parent_file_id = u.file_id group by u.volume, u.node""")
def folder_rollup_maintained(fx: Fixtures):
    """The stored rollup after all rows of the log, those of folders included."""
    stored = fx.keep("rollup", lambda: rollup.build(S.facts(fx), S.chain(fx)), ("volume", "file_id"))
    change, _ = rollup.changes(stored, S.facts(fx), _replayed(fx), moved_log(fx), S.chain(fx))
    return rollup.applied(stored, change).select("volume", "file_id", "name", "size", "item_count")
