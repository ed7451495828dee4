"""History, snapshots and differences."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgertree.functions.display import displayable
from ledgertree.operators import blocks, bounds, history, snapshots, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.ingest_queries import LOG_COLUMNS, LOG_TEXT
from ledgertree.plans.registry import part, query, stamp

part("busy_file", "", """
 select volume, file_id from (select volume, file_id, count(*) as n from fx_log group by volume, file_id)
 order by n desc, volume, file_id limit 1""")
part("busy_folder", "", """
 select volume, parent_file_id as file_id from (select volume, parent_file_id, count(*) as n from fx_log group by volume, parent_file_id)
 order by n desc, volume, file_id limit 1""")


def _busiest(fx: Fixtures, column: str):
    counts = S.raw_log(fx).groupBy("volume", column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "volume", column).first()


@query("history_file", f"select {LOG_TEXT} from logc semi join busy_file using (volume, file_id)")
def history_file(fx: Fixtures):
    """By the path of the file with most rows."""
    row = _busiest(fx, "file_id")
    own = S.facts(fx).filter((F.col("volume") == row.volume) & (F.col("file_id") == row.file_id))
    place = tree.with_path(own, S.chain(fx)).first()
    return history.for_path(S.log(fx), S.facts(fx), f"{place.volume}/{place.path}").select(*LOG_COLUMNS)


@query("history_directory", f"""
select {LOG_TEXT} from logc l where exists (
  select 1 from busy_folder b where b.volume = l.volume and (b.file_id = l.file_id or b.file_id = l.parent_file_id))""")
def history_directory(fx: Fixtures):
    row = _busiest(fx, "parent_file_id")
    folder = history.is_directory(S.facts(fx), S.log(fx), row.volume, row.parent_file_id)
    return history.for_item(S.log(fx), row.volume, row.parent_file_id, folder).select(*LOG_COLUMNS)


@query("history_time_kind_filter", f"""
select {LOG_TEXT} from logc where "at" >= timestamp '2024-01-10 00:00:00' and "at" <= timestamp '2024-01-20 00:00:00'
  and kind = 'Renamed'""")
def history_time_kind_filter(fx: Fixtures):
    return history.in_range(
        S.log(fx), datetime(2024, 1, 10), datetime(2024, 1, 20), "RENAMED"
    ).select(*LOG_COLUMNS)


# Rows of every file, and of every folder's children.
part("item_rows", "", """
 select volume, file_id as item_id, * exclude (volume) from logc
 union all
 select l.volume, l.parent_file_id as item_id, l.* exclude (volume) from logc l
 join fx_facts d on d.volume = l.volume and d.file_id = l.parent_file_id and d.is_directory""")


def _runs(name: str, same: str) -> None:
    part(f"{name}_marked", "", f"""
 select *, case when {same} then 0 else 1 end as starts from item_rows
 window w as (partition by volume, item_id order by sequence)""")
    part(f"{name}_numbered", "", f"""
 select *, sum(starts) over (partition by volume, item_id order by sequence rows unbounded preceding) as run from {name}_marked""")
    part(name, "", f"""
 select volume, item_id, max(sequence) as sequence, min(file_id) as file_id, arg_max(parent_file_id, sequence) as parent_file_id,
        arg_max(name, sequence) as name, min(kind) as kind, arg_min(is_directory, sequence) as is_directory,
        cast(sum(size_delta) as bigint) as size_delta, arg_max("at", sequence) as "at", arg_max(source, sequence) as source
 from {name}_numbered group by volume, item_id, run""")


_runs("merged_runs", "lag(kind) over w = kind and lag(file_id) over w = file_id and lag(name) over w = name and kind <> 'Modified'")
_runs("collapsed_runs", "lag(kind) over w = kind and lag(file_id) over w = file_id")

_RUN_TEXT = f"item_id, {LOG_TEXT}"
_RUN_COLUMNS = ["item_id", *LOG_COLUMNS]
_SHOWN = "(kind in ('Created', 'Deleted', 'Renamed') or abs(size_delta) >= 2)"


def _every_item(fx: Fixtures):
    """Every file with log rows and every folder, as history items."""
    files = S.log(fx).select("volume", F.col("file_id").alias("item_id")).distinct().withColumn(
        "is_directory", F.lit(False)
    )
    folders = S.facts(fx).filter("is_directory").select("volume", F.col("file_id").alias("item_id"), "is_directory")
    return history.for_items(S.log(fx), files.unionByName(folders))


def _keys(fx: Fixtures):
    return history.item_keys(S.log(fx))


@query("history_aggregate_identical", f"select {_RUN_TEXT} from merged_runs")
def history_aggregate_identical(fx: Fixtures):
    return history.merge_runs(_every_item(fx), counted=_keys(fx)).select(*_RUN_COLUMNS)


@query("history_collapse", f"select {_RUN_TEXT} from collapsed_runs")
def history_collapse(fx: Fixtures):
    return history.merge_runs(_every_item(fx), collapse=True, counted=_keys(fx)).select(*_RUN_COLUMNS)


@query("displayable_filter", f"select {_RUN_TEXT} from merged_runs where {_SHOWN}")
def displayable_filter(fx: Fixtures):
    return history.history(_every_item(fx), counted=_keys(fx)).select(*_RUN_COLUMNS)


part("folder_runs", "", f"""
 select m.* from merged_runs m join busy_folder b on b.volume = m.volume and b.file_id = m.item_id where {_SHOWN}""")


@query("history_page", f"""
select 'forward' as way, sequence, kind, name, size_delta from (
  select * from folder_runs where sequence > (select m // 3 from log_end) order by sequence limit 10)
union all
select 'backward' as way, sequence, kind, name, size_delta from (
  select * from folder_runs where sequence < (select m // 3 from log_end) order by sequence desc limit 10)""")
def history_page(fx: Fixtures):
    row = _busiest(fx, "parent_file_id")
    rows = history.for_item(S.log(fx), row.volume, row.parent_file_id, True)
    third = S.log_end(fx) // 3
    known = S.log_stats(fx).filter(F.col("volume") == row.volume).first()
    ends = (known.min_sequence, known.max_sequence)

    def way(name: str, cursor: str):
        return history.fetch_page(rows, 10, cursor, ends=ends, span=256).select(F.lit(name).alias("way"), "sequence", "kind", "name", "size_delta")

    return way("forward", f"f:{third}").unionByName(way("backward", f"b:{third}"))


@query("history_truncated_flag", f"""
select volume, {stamp('min("at")')} as oldest_at, min("at") <= timestamp '2024-01-02 00:05:00' as truncated,
       true as asked_truncated from fx_log group by volume""")
def history_truncated_flag(fx: Fixtures):
    month = timedelta(days=30)
    flag = history.truncated(S.log(fx), S.NOW_AT, month, stats=S.log_stats(fx))
    asked = history.truncated(S.log(fx), S.NOW_AT, month, since=datetime(2024, 1, 1), stats=S.log_stats(fx))
    return flag.join(asked.select("volume", F.col("truncated").alias("asked_truncated")), "volume")


@query("renamed_from", f"""
select item_id, volume, sequence, kind, name,
       case when kind = 'Renamed' then lag(name) over (partition by volume, item_id, file_id order by sequence) end as renamed_from
from merged_runs where {_SHOWN}""")
def renamed_from(fx: Fixtures):
    rows = history.history(_every_item(fx), counted=_keys(fx))
    return history.renamed_from(rows).select("item_id", "volume", "sequence", "kind", "name", "renamed_from")


@query("history_match_counts", """
select count(*) as total, count(*) filter (where l.volume = b.volume and l.file_id = b.file_id) as matched,
       count(*) filter (where l.volume = b.volume and l.parent_file_id = b.file_id) as parent_matched
from fx_log l cross join busy_folder b""")
def history_match_counts(fx: Fixtures):
    row = _busiest(fx, "parent_file_id")
    return history.match_counts(S.log(fx), row.volume, row.parent_file_id)


# --- snapshots -------------------------------------------------------------------------------


@query("snapshot_create", """
select 'snap_20240201_000000' as label, l.volume, l.sequence_number, f.facts_count from
 (select volume, max(sequence) as sequence_number from fx_log group by volume) l
 join (select volume, count(*) as facts_count from fx_facts group by volume) f on f.volume = l.volume""")
def snapshot_create(fx: Fixtures):
    parents, _ = S.snapshot_tables(fx)
    parent, children = snapshots.create_snapshot(S.log(fx), S.facts(fx), parents, S.NOW_AT, snapshot_id="s_d")
    rows = children.join(parent.select(F.col("id").alias("parent_id"), "label"), "parent_id")
    return rows.select("label", "volume", "sequence_number", "facts_count")


# One snapshot for each day with changes, taken at the last of them; every other day's is automatic.
part("daily", "", """
 select case when day(d) % 2 = 1 then 'auto_' else 'own_' end || strftime(d, '%Y-%m-%d') as label, last_at as created_at
 from (select cast("at" as date) as d, max("at") as last_at from fx_log group by 1)""")


@query("snapshot_auto_due", f"""
select {stamp("max(created_at) filter (where starts_with(label, 'auto_'))")} as last_at,
       max(created_at) filter (where starts_with(label, 'auto_')) <= timestamp '2024-01-31 00:00:00' as due from daily""")
def snapshot_auto_due(fx: Fixtures):
    days = S.log(fx).groupBy(F.to_date("at").alias("d")).agg(F.max("at").alias("created_at"))
    kind = F.when(F.dayofmonth("d") % 2 == 1, "auto_").otherwise("own_")
    daily = days.select(F.concat(kind, F.date_format("d", "yyyy-MM-dd")).alias("label"), "created_at")
    return snapshots.auto_snapshot_due(daily, timedelta(days=1), S.NOW_AT)


part("nested", "", """
 select p.id, p.label, p.created_at,
        string_agg(c.volume || '=' || cast(c.sequence_number as varchar) || '/' || cast(c.facts_count as varchar), ',' order by c.volume) as volumes
 from parents p join children c on c.parent_id = p.id group by all""")


def _flat(df):
    each = F.transform(
        "volumes", lambda v: F.format_string("%s=%d/%d", v["volume"], v["sequence_number"], v["facts_count"])
    )
    return df.select("id", "label", "created_at", F.array_join(each, ",").alias("volumes"))


@query("snapshot_list", f"""
select p.id, p.label, {stamp('p.created_at')} as created_at,
       'E:=' || cast(c.sequence_number as varchar) || '/' || cast(c.facts_count as varchar) as volumes
from parents p join children c on c.parent_id = p.id and c.volume = 'E:' order by p.created_at desc limit 2""")
def snapshot_list(fx: Fixtures):
    return _flat(snapshots.list_snapshots(*S.snapshot_tables(fx), volume="e:", limit=2))


@query("snapshot_lookup", f"select id, label, {stamp('created_at')} as created_at, volumes from nested where label in ('a', 'auto_c')")
def snapshot_lookup(fx: Fixtures):
    tables = S.snapshot_tables(fx)
    by_label, by_id = snapshots.get_snapshot(*tables, "a"), snapshots.get_snapshot(*tables, "s_c")
    return _flat(by_label.unionByName(by_id))


@query("snapshot_delete_cascade", f"select id, label, {stamp('created_at')} as created_at, volumes from nested where id <> 's_b'")
def snapshot_delete_cascade(fx: Fixtures):
    return _flat(snapshots.nested(*snapshots.delete_snapshot(*S.snapshot_tables(fx), "b")))


# The difference, row by row: state of each file after each of its rows.
part("diff_steps", "", """
 select l.*, row_number() over (partition by l.volume, l.file_id order by l.sequence) as step
 from (select a.*, lag(a.name) over f as before_name, lag(a.parent_file_id) over f as before_parent from logc a
       window f as (partition by a.volume, a.file_id order by a.sequence)) l
 join win w on w.volume = l.volume and l.sequence > w.lo and l.sequence <= w.hi""")
part("diff_fold", "(volume, file_id, step, kind, parent_file_id, name, is_directory, size_delta, old_name, old_parent)", """
 select volume, file_id, step, kind, parent_file_id, name, is_directory, size_delta,
        case when kind = 'Renamed' then coalesce(before_name, name) end,
        case when kind = 'Renamed' then coalesce(before_parent, parent_file_id) end
 from diff_steps where step = 1
 union all
 select s.volume, s.file_id, s.step,
        case when f.kind is null then s.kind
             when s.kind = 'Created' then case when f.kind = 'Deleted' then 'Modified' else f.kind end
             when s.kind = 'Modified' then f.kind
             when s.kind = 'Renamed' then case when f.kind in ('Created', 'Renamed') then f.kind else 'Renamed' end
             when f.kind = 'Created' then null else 'Deleted' end,
        case when f.kind is null or s.kind in ('Created', 'Renamed') then s.parent_file_id else f.parent_file_id end,
        case when f.kind is null or s.kind in ('Created', 'Renamed') then s.name else f.name end,
        case when f.kind is null then s.is_directory else f.is_directory end,
        case when f.kind is null then s.size_delta when s.kind = 'Renamed' then f.size_delta else f.size_delta + s.size_delta end,
        case when s.kind = 'Renamed' and (f.kind is null or f.kind in ('Modified', 'Deleted')) then coalesce(s.before_name, s.name)
             when f.kind is null then null else f.old_name end,
        case when s.kind = 'Renamed' and (f.kind is null or f.kind in ('Modified', 'Deleted')) then coalesce(s.before_parent, s.parent_file_id)
             when f.kind is null then null else f.old_parent end
 from diff_fold f join diff_steps s on s.volume = f.volume and s.file_id = f.file_id and s.step = f.step + 1""")
part("net", "", """
 select volume, file_id, parent_file_id, name, is_directory, cast(size_delta as bigint) as size_delta, kind, old_name,
        old_parent as old_parent_file_id
 from (select *, row_number() over (partition by volume, file_id order by step desc) as r from diff_fold)
 where r = 1 and kind is not null""")
part("net_paths", "", f"""
 select n.*, n.volume || case when coalesce(d.dir_path, '') = '' then '' else '/' || d.dir_path end || '/' || n.name as path
 from net n left join (select volume as v, file_id as parent, dir_path from dirpath) d on d.v = n.volume and d.parent = n.parent_file_id
 where {_SHOWN}""")


@query("snapshot_diff", "select volume, file_id, parent_file_id, name, is_directory, size_delta, kind, path from net_paths")
def snapshot_diff(fx: Fixtures):
    found = snapshots.snapshot_diff(
        S.placed_log(fx), S.facts(fx), *S.snapshot_tables(fx), "b", "a",
        chain=S.chain(fx), stats=S.log_stats(fx), blocks=S.log_blocks(fx),
    )
    return found.drop("old_name", "old_parent_file_id")


@query("diff_old_name", "select volume, file_id, kind, name, old_name, old_parent_file_id from net")
def diff_old_name(fx: Fixtures):
    changes = blocks.net_changes(S.placed_log(fx), S.log_blocks(fx), S.window_ab(fx))
    return changes.select("volume", "file_id", "kind", "name", "old_name", "old_parent_file_id")


@query("diff_path_prefix", "select path, kind, size_delta from net_paths where starts_with(lower(path), 'd:/nation_1')")
def diff_path_prefix(fx: Fixtures):
    found = snapshots.snapshot_diff(
        S.placed_log(fx), S.facts(fx), *S.snapshot_tables(fx), "a", "b", path_prefix="D:\\nation_1",
        chain=S.chain(fx), stats=S.log_stats(fx), blocks=S.log_blocks(fx),
    )
    return found.select("path", "kind", "size_delta")


@query("diff_expired_check", """
select w.volume, w.lo as start_seq, k.oldest_seq, w.lo < k.oldest_seq and k.oldest_seq > 1 as expired from win w
join (select volume, min(sequence) as oldest_seq from fx_log where "at" >= timestamp '2024-01-15 00:00:00' group by volume) k
  on k.volume = w.volume""")
def diff_expired_check(fx: Fixtures):
    kept = S.log(fx).filter(F.col("at") >= F.lit(S.SINCE))
    return bounds.window_findings(kept, S.window_ab(fx))
