"""Hierarchy and rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgertree.operators import bounds, intervals, rank, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.registry import PARTS, part, query, stamp


@query("ancestor_closure", "select volume, file_id, node as ancestor_id, cast(depth as bigint) as depth from up where depth > 0")
def ancestor_closure(fx: Fixtures):
    return tree.closure(tree.chains(tree.directories(S.facts(fx))))


part("paths", "", """
 select f.volume, f.file_id, f.parent_file_id, f.name, f.is_directory, f.size,
        case when f.name = f.volume then '' when coalesce(d.dir_path, '') = '' then f.name
             else d.dir_path || '/' || f.name end as path
 from fx_facts f left join (select volume as v, file_id as parent, dir_path from dirpath) d
   on d.v = f.volume and d.parent = f.parent_file_id and f.parent_file_id <> f.file_id""")


@query("resolve_paths", "select volume, file_id, path from paths")
def resolve_paths(fx: Fixtures):
    return tree.with_path(S.facts(fx), S.chain(fx)).select("volume", "file_id", "path")


part("asked", "", "select lower(volume) || chr(92) || upper(path) as path, volume, file_id from paths")


@query("path_to_id", "select path, volume, min(file_id) as file_id, 'facts' as found_in from asked group by path, volume")
def path_to_id(fx: Fixtures):
    """Every path of the inventory, in other letter case and with a backslash."""
    known = tree.with_path(S.facts(fx), S.chain(fx))
    asked = known.select(F.concat(F.lower("volume"), F.lit("\\"), F.upper("path")).alias("path"))
    return tree.lookup_paths(asked, S.facts(fx), S.chain(fx))


part("log_paths", "", """
 select l.volume, l.file_id, l.sequence, l.volume || '/' || d.dir_path || '/' || l.name as path
 from fx_log l join dirpath d on d.volume = l.volume and d.file_id = l.parent_file_id""")
part("live_paths", "", """
 select f.volume || '/' || d.dir_path || '/' || f.name as path, min(f.file_id) as file_id
 from replayed f join dirpath d on d.volume = f.volume and d.file_id = f.parent_file_id group by 1""")


@query("path_to_id_deleted_fallback", """
select p.path, p.volume, coalesce(v.file_id, p.log_id) as file_id,
       case when v.file_id is null then 'log' else 'facts' end as found_in
from (select path, volume, arg_max(file_id, sequence) as log_id from log_paths group by path, volume) p
left join live_paths v on v.path = p.path""")
def path_to_id_deleted_fallback(fx: Fixtures):
    """Every path the log ever gave a file, against the facts after the log."""
    dirs = tree.directory_paths(S.chain(fx)).withColumnRenamed("file_id", "parent_file_id")
    asked = S.raw_log(fx).join(dirs, ["volume", "parent_file_id"]).select(
        F.concat_ws("/", "volume", "dir_path", "name").alias("path")
    )
    return tree.lookup_paths(asked, S.replayed(fx), S.chain(fx), S.raw_log(fx))


@query("subtree_filter", """
select volume, file_id, name, size from fx_facts where volume = 'C:' and file_id <> 100
  and parent_file_id in (select file_id from up where volume = 'C:' and node = 100)""")
def subtree_filter(fx: Fixtures):
    below = intervals.subtree(S.labelled_facts(fx), S.folder_numbers(fx), S.chain(fx), "C:", 100)
    return below.select("volume", "file_id", "name", "size")


part("sizes", "", """
 select volume, parent_file_id, sum(size) as size, count(*) as n from fx_facts where not is_directory
 group by volume, parent_file_id""")
part("rolled", "", """
 select u.volume, u.node as file_id, max(u.name) as name, cast(coalesce(sum(s.size), 0) as bigint) as size,
        cast(coalesce(sum(s.n), 0) as bigint) as item_count
 from up u left join sizes s on s.volume = u.volume and s.parent_file_id = u.file_id
 group by u.volume, u.node""")


@query("folder_rollup_size", "select volume, file_id, name, size, item_count from rolled")
def folder_rollup_size(fx: Fixtures):
    return tree.rollup_sizes(S.facts(fx), S.chain(fx))


@query("folder_rollup_intervals", "select volume, file_id, name, size, item_count from rolled")
def folder_rollup_intervals(fx: Fixtures):
    """The same from running sums over the folders' interval labels."""
    return intervals.rollup_sizes(S.facts(fx), S.folder_numbers(fx), S.chain(fx))


part("items", "", """
 select volume, file_id, arg_max(parent_file_id, sequence) as parent_file_id, arg_max(name, sequence) as name,
        cast(sum(size_delta) as bigint) as size_delta, count(*) as churn from logw group by volume, file_id""")
part("changed", "", """
 select volume, parent_file_id, sum(size_delta) as d, sum(churn) as c, count(*) as n from items
 group by volume, parent_file_id""")
part("rolled_changes", "", """
 select u.volume, u.node as file_id, max(u.name) as name, cast(coalesce(sum(d), 0) as bigint) as size_delta,
        cast(coalesce(sum(c), 0) as bigint) as churn, cast(coalesce(sum(n), 0) as bigint) as item_count
 from up u left join changed s on s.volume = u.volume and s.parent_file_id = u.file_id
 group by u.volume, u.node""")


def _items(fx: Fixtures):
    return rank.changed_items(bounds.in_window(S.log(fx), S.window_ab(fx)))


@query("folder_rollup_delta", "select volume, file_id, name, size_delta, churn, item_count from rolled_changes")
def folder_rollup_delta(fx: Fixtures):
    items = _items(fx)
    return tree.rollup_changes(items, rank.change_chains(S.facts(fx), items, S.chain(fx)))


# Folder rows for the log: every seventh customer's folder moves to the top of its volume under
# a new name, every eleventh is deleted, and some nations get a new folder.
part("moves", "", """
 select chr(67+n_regionkey)||':' as volume, cast(1000+c_custkey as bigint) as file_id,
        case when c_custkey % 7 = 0 then cast(n_regionkey+1 as bigint) else cast(100+c_nationkey as bigint) end as parent_file_id,
        case when c_custkey % 7 = 0 then 'moved_' || cast(c_custkey as varchar(20)) else c_name end as name,
        case when c_custkey % 7 = 0 then 'Renamed' else 'Deleted' end as kind
 from customer join nation on c_nationkey = n_nationkey where c_custkey % 7 = 0 or c_custkey % 11 = 0
 union all
 select chr(67+n_regionkey)||':', cast(500+n_nationkey as bigint), cast(100+n_nationkey as bigint), 'new_' || n_name, 'Created'
 from nation where n_nationkey % 3 = 0""")
part("items_m", "", """
 select volume, file_id, parent_file_id, name, size_delta, churn from items
 union all
 select m.volume, file_id, parent_file_id, name, cast(0 as bigint), 1 from moves m join win w on w.volume = m.volume""")
part("nodes_m", "", """
 select volume, file_id, parent_file_id, name from fx_facts f
 where is_directory and not exists (select 1 from moves m where m.volume = f.volume and m.file_id = f.file_id)
 union all select volume, file_id, parent_file_id, name from moves""")
part("up_m", "(volume, file_id, node, name, nxt, depth)", """
 select volume, file_id, file_id, name,
        case when parent_file_id <> file_id and parent_file_id <> 0 then parent_file_id end, 0 from nodes_m
 union all
 select u.volume, u.file_id, d.file_id, d.name,
        case when d.parent_file_id <> d.file_id and d.parent_file_id <> 0 then d.parent_file_id end, u.depth + 1
 from up_m u join nodes_m d on d.volume = u.volume and d.file_id = u.nxt""")
part("rolled_changes_m", "", """
 select u.volume, u.node as file_id, max(u.name) as name, cast(coalesce(sum(d), 0) as bigint) as size_delta,
        cast(coalesce(sum(c), 0) as bigint) as churn, cast(coalesce(sum(n), 0) as bigint) as item_count
 from up_m u left join (
   select volume, parent_file_id, sum(size_delta) as d, sum(churn) as c, count(*) as n from items_m
   where parent_file_id <> file_id group by volume, parent_file_id) s
   on s.volume = u.volume and s.parent_file_id = u.file_id
 group by u.volume, u.node""")


def moved_log(fx: Fixtures):
    """The log with those folder rows at the end of the window."""
    for name in ("customer", "nation"):
        fx.base(name).createOrReplaceTempView(name)
    ends = S.window_ab(fx).select("volume", F.col("end_seq").alias("sequence"))
    log, moves = S.log(fx), PARTS["moves"].removeprefix("moves as (").removesuffix(")")
    rows = fx.spark.sql(moves).join(ends, "volume")
    rows = rows.withColumns(
        {"is_directory": F.lit(True), "size_delta": F.lit(0), "source": F.lit("Watcher"), "at": F.lit(S.NOW_AT)}
    )
    known = [F.col(f.name).cast(f.dataType) for f in log.schema.fields if f.name in rows.columns]
    return log.unionByName(rows.select(*known), allowMissingColumns=True)


def _moved_items(fx: Fixtures):
    rows = rank.changed_items(bounds.in_window(moved_log(fx), S.window_ab(fx)))
    return fx.keep("moved-items", lambda: rows)


@query("folder_rollup_delta_moved", "select volume, file_id, name, size_delta, churn, item_count from rolled_changes_m")
def folder_rollup_delta_moved(fx: Fixtures):
    """Folders renamed, moved, created and deleted in the window; only their chains are walked anew."""
    items = _moved_items(fx)
    return tree.rollup_changes(items, rank.change_chains(S.facts(fx), items, S.chain(fx)))


# --- rankings ------------------------------------------------------------------------------


@query("top_files_by_size", """
select p.volume, p.file_id, p.name, p.size, coalesce(d.dir_path, '') as path from paths p
left join (select volume as v, file_id as parent, dir_path from dirpath) d on d.v = p.volume and d.parent = p.parent_file_id
where not is_directory order by size desc, name, file_id desc limit 20""")
def top_files_by_size(fx: Fixtures):
    ranked = rank.top(S.facts(fx), files=True, chain=S.chain(fx))
    return ranked.select("volume", "file_id", "name", "size", "path")


# Folders of every volume, the roots left out.
part("ranked_c", "", """
 select r.*, d.dir_path from rolled r join dirpath d on d.volume = r.volume and d.file_id = r.file_id
 where r.name <> r.volume""")


@query("top_folders_by_size", """
select volume, file_id, name, size, item_count,
       case when contains(dir_path, '/') then regexp_replace(dir_path, '/[^/]*$', '') else '' end as path
from ranked_c r where not exists (
  select 1 from up u join ranked_c a on a.volume = u.volume and a.file_id = u.node
  where u.volume = r.volume and u.file_id = r.file_id and u.depth > 0
    and (a.size > r.size or (a.size = r.size and (a.name < r.name or (a.name = r.name and a.file_id > r.file_id)))))
order by size desc, name, file_id desc, volume limit 20""")
def top_folders_by_size(fx: Fixtures):
    ranked = rank.top(S.facts(fx), folders=True, below_roots=True, chain=S.chain(fx))
    return ranked.select("volume", "file_id", "name", "size", "item_count", "path")


part("ranked_w", "", """
 select r.*, d.dir_path from rolled r join dirpath d on d.volume = r.volume and d.file_id = r.file_id
 where r.volume = 'C:' and r.file_id <> 100 and r.file_id in (select file_id from up where volume = 'C:' and node = 100)""")


@query("top_folders_within", """
select volume, file_id, name, size, item_count,
       case when contains(dir_path, '/') then regexp_replace(dir_path, '/[^/]*$', '') else '' end as path
from ranked_w r where not exists (
  select 1 from up u join ranked_w a on a.volume = u.volume and a.file_id = u.node
  where u.volume = r.volume and u.file_id = r.file_id and u.depth > 0
    and (a.size > r.size or (a.size = r.size and (a.name < r.name or (a.name = r.name and a.file_id > r.file_id)))))
order by size desc, name, file_id desc, volume limit 20""")
def top_folders_within(fx: Fixtures):
    """The largest folders of one nation; only the range of facts below it is read."""
    ranked = rank.top(
        S.labelled_facts(fx), folders=True, within=("C:", 100), chain=S.chain(fx), numbers=S.folder_numbers(fx)
    )
    return ranked.select("volume", "file_id", "name", "size", "item_count", "path")


@query("top_files_within", """
select p.volume, p.file_id, p.name, p.size, coalesce(d.dir_path, '') as path from paths p
left join (select volume as v, file_id as parent, dir_path from dirpath) d on d.v = p.volume and d.parent = p.parent_file_id
where not is_directory and p.volume = 'C:' and p.parent_file_id in (select file_id from up where volume = 'C:' and node = 100)
order by size desc, name, file_id desc limit 20""")
def top_files_within(fx: Fixtures):
    ranked = rank.top(S.labelled_facts(fx), files=True, within=("C:", 100), chain=S.chain(fx), numbers=S.folder_numbers(fx))
    return ranked.select("volume", "file_id", "name", "size", "path")


@query("interval_bounds_since", """
select volume, min(case when at >= timestamp '2024-01-15 00:00:00' then sequence end) - 1 as start_seq,
       max(sequence) as end_seq from fx_log group by volume having start_seq is not null""".replace(" at >=", ' "at" >='))
def interval_bounds_since(fx: Fixtures):
    return bounds.bounds_since(S.log(fx), S.SINCE, S.log_stats(fx))


@query("interval_bounds_between", "select volume, lo as start_seq, hi as end_seq from win")
def interval_bounds_between(fx: Fixtures):
    return bounds.bounds_between(S.snapshot_tables(fx)[1], "s_b", "s_a")


_GROWN = "(size_delta <> 0 or churn <> 0) and (size_delta = 0 or abs(size_delta) >= 2)"


@query("top_growth_files", f"""
select volume, file_id, name, size_delta, churn from items where {_GROWN}
order by abs(size_delta) desc, name, file_id desc, volume limit 50""")
def top_growth_files(fx: Fixtures):
    ranked = rank.top(
        S.facts(fx), S.log(fx), S.snapshot_tables(fx)[1], files=True, growth=True, between=("s_a", "s_b"), limit=50,
        chain=S.chain(fx), stats=S.log_stats(fx),
    )
    return ranked.select("volume", "file_id", "name", "size_delta", "churn")


part("grown", "", f"select *, abs(size_delta) as value from rolled_changes where {_GROWN}")
part("churned", "", "select *, churn as value from rolled_changes where size_delta <> 0 or churn <> 0")


def _not_nested(table: str) -> str:
    return f"""not exists (
  select 1 from up u join {table} a on a.volume = u.volume and a.file_id = u.node
  where u.volume = r.volume and u.file_id = r.file_id and u.depth > 0
    and (a.value > r.value or (a.value = r.value and (a.name < r.name or (a.name = r.name and a.file_id > r.file_id)))))"""


_FOLDER = "volume, file_id, name, size_delta, churn, item_count"


@query("top_growth_folders", f"""
select {_FOLDER} from grown r where {_not_nested('grown')} order by value desc, name, file_id desc, volume limit 50""")
def top_growth_folders(fx: Fixtures):
    ranked = rank.top(
        S.facts(fx), S.log(fx), S.snapshot_tables(fx)[1], growth=True, between=("s_a", "s_b"), limit=50, chain=S.chain(fx),
        stats=S.log_stats(fx),
    )
    return ranked.select("volume", "file_id", "name", "size_delta", "churn", "item_count")


part("grown_m", "", f"select *, abs(size_delta) as value from rolled_changes_m where {_GROWN}")


@query("top_growth_folders_moved", f"""
select {_FOLDER} from grown_m r where {_not_nested('grown_m').replace('from up u', 'from up_m u')}
order by value desc, name, file_id desc, volume limit 50""")
def top_growth_folders_moved(fx: Fixtures):
    ranked = rank.top(
        S.facts(fx), moved_log(fx), S.snapshot_tables(fx)[1], growth=True, between=("s_a", "s_b"), limit=50, chain=S.chain(fx),
        stats=S.log_stats(fx),
    )
    return ranked.select("volume", "file_id", "name", "size_delta", "churn", "item_count")


part("since_items", "", """
 select l.volume, l.file_id, arg_max(l.name, sequence) as name, cast(sum(size_delta) as bigint) as size_delta, count(*) as churn
 from logc l join (select volume, min(sequence) as lo from fx_log where "at" >= timestamp '2024-01-15 00:00:00' group by volume) s
   on s.volume = l.volume and l.sequence >= s.lo group by l.volume, l.file_id""")


@query("top_churn", """
select volume, file_id, name, churn, size_delta from since_items
order by churn desc, name, file_id desc, volume limit 50""")
def top_churn(fx: Fixtures):
    ranked = rank.top(
        S.facts(fx), S.log(fx), files=True, churn=True, since=S.SINCE, limit=50, chain=S.chain(fx), stats=S.log_stats(fx)
    )
    return ranked.select("volume", "file_id", "name", "churn", "size_delta")


@query("nested_folder_suppression", f"select {_FOLDER} from grown r where {_not_nested('grown')}")
def nested_folder_suppression(fx: Fixtures):
    items = _items(fx)
    chain = rank.change_chains(S.facts(fx), items, S.chain(fx))
    kept = rank.suppress_nested(rank.folders_by_change(items, chain), chain)
    return kept.select("volume", "file_id", "name", "size_delta", "churn", "item_count")


@query("top_keyset_page", """
select volume, file_id, name, size from fx_facts where not is_directory
order by size desc, name, file_id desc, volume limit 30 offset 30""")
def top_keyset_page(fx: Fixtures):
    ranked = rank.files_by_size(S.facts(fx))
    first = rank.page(ranked, 30).collect()
    following = rank.page(ranked, 30, rank.encode_cursor(first[-1]))
    return following.select("volume", "file_id", "name", "size")


@query("history_sufficiency", """
select volume, round(cast(epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(min("at"))) as bigint) / 86400.0, 4)::double as days_available,
       31.0::double as days_needed,
       round(cast(epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(min("at"))) as bigint) / 86400.0, 4) >= 31.0 as sufficient
from fx_log group by volume""")
def history_sufficiency(fx: Fixtures):
    return bounds.history_findings(S.log(fx), datetime(2024, 1, 1), S.NOW_AT, S.log_stats(fx))


@query("ranking_report", """
select volume, file_id, name,
       case when value >= 1073741824 then printf('%.2f GB', value / 1073741824.0)
            when value >= 1048576 then printf('%.2f MB', value / 1048576.0)
            when value >= 1024 then printf('%.2f KB', value / 1024.0) else printf('%d B', value) end as plain,
       case when size_delta > 0 then '+' when size_delta < 0 then '-' else '' end as sign,
       case when size_delta > 0 then '+' else '' end || cast(size_delta as varchar) || ' B' as exact,
       'Folder' as type, volume || case when dir_path = '' or not contains(dir_path, '/') then '' else '/' || regexp_replace(dir_path, '/[^/]*$', '') end as full_path,
       cast(item_count as varchar) as items, '[a..b]' as bounds
from (select r.*, d.dir_path from grown r join dirpath d on d.volume = r.volume and d.file_id = r.file_id)""")
def ranking_report(fx: Fixtures):
    items = _items(fx)
    chain = rank.change_chains(S.facts(fx), items, S.chain(fx))
    ranked = rank.with_parent_path(rank.folders_by_change(items, chain), chain)
    report = rank.ranking_report(ranked, "growth", ("a", "b"))
    return report.select(
        "volume", "file_id", "name",
        F.regexp_replace("measure", "^[+-]", "").alias("plain"),
        F.regexp_extract("measure", "^([+-]?)", 1).alias("sign"),
        "exact", "type", "full_path", "items", "bounds",
    )
