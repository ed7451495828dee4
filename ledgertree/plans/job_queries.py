"""Maintenance jobs, conversation tables and ad-hoc SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgertree.operators import adhoc, conversation as C, maintain as M, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.ingest_queries import LOG_COLUMNS, LOG_TEXT
from ledgertree.plans.registry import part, query, stamp
from ledgertree.schema import LIVE
from ledgertree.session import new_path
from ledgertree.sources import tables
from ledgertree.sources.listing import upsert_latest

part("vstate", "", """
 select distinct volume, case when volume = 'G:' then 'Reconciling' else 'Live' end as state from fx_facts""")
part("prune_runs", "", """
 select s.volume, timestamp '2024-02-01 00:00:00' as run_at,
        case when s.state = 'Live' then 'SUCCESS' else 'SKIPPED' end as status,
        case when s.state = 'Live' then 'Deleted ' || cast(coalesce(x.n, 0) as varchar) || ' rows older than 2024-01-12T00:00:00+00:00'
             else 'Volume is mid-replay or baseline scanning' end as details
 from vstate s left join (select volume, count(*) as n from fx_log where "at" < timestamp '2024-01-12 00:00:00' group by volume) x
   on x.volume = s.volume""")


def _pruned(fx: Fixtures):
    return M.retention_prune(S.log(fx), S.states(fx), timedelta(days=20), S.NOW_AT)


@query("retention_prune", f"""
select volume, count(*) as n, min(sequence) as oldest, (select details from prune_runs r where r.volume = l.volume) as details
from (select * from fx_log where "at" >= timestamp '2024-01-12 00:00:00' or volume = 'G:') l group by volume""")
def retention_prune(fx: Fixtures):
    kept, runs = _pruned(fx)
    left = kept.groupBy("volume").agg(F.count("*").alias("n"), F.min("sequence").alias("oldest"))
    return left.join(runs.select("volume", "details"), "volume")


# A run per volume and day with changes, at the last of them; runs of volumes in replay were skipped.
part("daily_runs", "", """
 select max("at") as run_at, case when s.state = 'Live' then 'SUCCESS' else 'SKIPPED' end as status
 from fx_log l join vstate s on s.volume = l.volume group by l.volume, s.state, cast("at" as date)""")


@query("prune_due", f"""
select {stamp("max(run_at) filter (where status = 'SUCCESS')")} as last_success,
       max(run_at) filter (where status = 'SUCCESS') <= timestamp '2024-01-31 00:00:00' as due from daily_runs""")
def prune_due(fx: Fixtures):
    days = S.log(fx).groupBy("volume", F.to_date("at").alias("d")).agg(F.max("at").alias("run_at"))
    status = F.when(F.col("state") == LIVE, "SUCCESS").otherwise("SKIPPED")
    return M.prune_due(days.join(S.states(fx), "volume").select("run_at", status.alias("status")), S.NOW_AT)


@query("prune_log_latest", f"select volume, {stamp('run_at')} as run_at, status, details from prune_runs")
def prune_log_latest(fx: Fixtures):
    return M.latest_runs(_pruned(fx)[1])


# Retention texts made from the turns, so that good and bad ones occur.
part("settings", "", """
 select cast(conv_id as varchar) || '-' || cast(turn as varchar) as id, role as label,
        case turn % 4 when 0 then cast(conv_id as varchar) || 'd' when 1 then cast(conv_id as varchar) || ' h'
             when 2 then 'w' || cast(conv_id as varchar) else cast(conv_id as varchar) || case when conv_id % 2 = 0 then 'm' else 'fortnight' end end as retention_setting,
        timestamp '2024-01-01 00:00:00' + to_days(cast(conv_id % 31 as integer)) as created_at
 from conversations""")
part("durations", "", """
 select *, try_cast(regexp_extract(retention_setting, '^([0-9]+)', 1) as bigint) *
        case trim(regexp_replace(retention_setting, '^[0-9]+', '')) when 'd' then 86400 when 'h' then 3600 when 'm' then 2592000 end as secs
 from settings""")


@query("retention_resolve", f"""
select id, label, retention_setting, case when secs between 3600 and 315360000 then secs end as seconds,
       case when starts_with(retention_setting, 'w') then 'digit after unit' when starts_with(retention_setting, '0') then 'not positive'
            when secs is null then 'unknown unit' when secs not between 3600 and 315360000 then 'out of range' end as problem,
       {stamp("case when secs between 3600 and 315360000 then timestamp '2024-02-01 00:00:00' - to_seconds(secs) end")} as cutoff,
       created_at < case when secs between 3600 and 315360000 then timestamp '2024-02-01 00:00:00' - to_seconds(secs) end as expired
from durations""")
def retention_resolve(fx: Fixtures):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn") % 4
    text = (
        F.when(turn == 0, F.concat(conv, F.lit("d")))
        .when(turn == 1, F.concat(conv, F.lit(" h")))
        .when(turn == 2, F.concat(F.lit("w"), conv))
        .otherwise(F.concat(conv, F.when(F.col("conv_id") % 2 == 0, F.lit("m")).otherwise(F.lit("fortnight"))))
    )
    snaps = fx.base("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("label"), text.alias("retention_setting"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") % 31) * 86400).alias("created_at"),
    )
    return M.resolve_retention(snaps, S.NOW_AT)


@query("volume_status", f"""
select s.volume, s.state, f.directories, f.files, f.bytes, l.last_sequence, c.last_sequence as cursor, l.n - h.n as pending,
       l.oldest_at, l.newest_at, 'BaselineScanning' as overall
from vstate s
join (select volume, count(*) filter (where is_directory) as directories, count(*) filter (where not is_directory) as files,
             cast(sum(size) as bigint) as bytes from fx_facts group by volume) f on f.volume = s.volume
join (select volume, max(sequence) as last_sequence, count(*) as n, {stamp('min("at")')} as oldest_at,
             {stamp('max("at")')} as newest_at from fx_log group by volume) l on l.volume = s.volume
join cur c on c.volume = s.volume
join (select volume, count(*) as n from log_head group by volume) h on h.volume = s.volume""")
def volume_status(fx: Fixtures):
    return M.volume_status(S.facts(fx), S.log(fx), S.start_cursors(fx), S.states(fx))


@query("incomplete_volumes", "select volume, file_id, volume = 'G:' as volume_incomplete from fx_facts")
def incomplete_volumes(fx: Fixtures):
    return M.with_incomplete(S.facts(fx).select("volume", "file_id"), S.states(fx))


# Facts with every kind of fault: repeated rows, folders gone, negative sizes, two folders in a ring.
part("faulty", "", """
 select volume, file_id, case when file_id = 101 then 106 when file_id = 106 then 101 else parent_file_id end as parent_file_id,
        name, is_directory, case when ends_with(name, '.tmp') then -size else size end as size
 from fx_facts where name <> 'NATION_2' and not (volume = 'E:' and parent_file_id = file_id)
 union all
 select volume, file_id, parent_file_id, name, is_directory, size from fx_facts where ends_with(name, '.PDF') and volume = 'F:'""")


@query("inventory_audit", """
select 'duplicate_file' as "check", volume, cast(file_id as varchar) as key, count(*) as n from faulty group by volume, file_id having count(*) > 1
union all
select 'orphan_parent', volume, cast(file_id as varchar), 1 from faulty f where parent_file_id <> file_id and parent_file_id <> 0
  and not exists (select 1 from faulty p where p.volume = f.volume and p.file_id = f.parent_file_id)
union all
select 'cycle', volume, cast(file_id as varchar), 1 from fx_facts
  where is_directory and (file_id in (101, 106) or parent_file_id in (101, 106))
union all
select 'missing_root', volume, volume, 1 from faulty group by volume having count(*) filter (where parent_file_id = file_id or name = volume) = 0
union all
select 'negative_size', volume, cast(file_id as varchar), 1 from faulty where size < 0
union all
select 'duplicate_label', null, label, count(*) from parents cross join (values (1), (2)) group by label
union all
select 'duplicate_volume_snapshot', volume, parent_id, 2 from children""")
def inventory_audit(fx: Fixtures):
    base = S.facts(fx)
    fid = F.col("file_id")
    ring = F.when(fid == 101, F.lit(106)).when(fid == 106, F.lit(101)).otherwise(F.col("parent_file_id"))
    kept = base.filter((F.col("name") != "NATION_2") & ~((F.col("volume") == "E:") & (fid == F.col("parent_file_id"))))
    broken = kept.withColumn("parent_file_id", ring.cast("long")).withColumn(
        "size", F.when(F.col("name").endswith(".tmp"), -F.col("size")).otherwise(F.col("size"))
    )
    twice = base.filter(F.col("name").endswith(".PDF") & (F.col("volume") == "F:"))
    parents, children = S.snapshot_tables(fx)
    return M.audit(broken.unionByName(twice), parents.unionByName(parents), children.unionByName(children))


@query("compact_log", f"select {LOG_TEXT} from logc")
def compact_log(fx: Fixtures):
    root, target = new_path(fx.spark, "scattered"), new_path(fx.spark, "compacted")
    tables.save(S.log(fx), root, "mutation_log")
    tables.compact(fx.spark, root, "mutation_log", target, files=2)
    return tables.load(fx.spark, target, "mutation_log").select(*LOG_COLUMNS)


# --- conversations -----------------------------------------------------------------------


@query("session_list", """
select conv_id, case when length(q) > 60 then substr(q, 1, 57) || '...' else q end as first_question, turns
from (select conv_id, arg_min(text, turn) filter (where role = 'user') as q, count(*) as turns from conversations group by conv_id)""")
def session_list(fx: Fixtures):
    return C.list_sessions(fx.base("conversations"))


@query("session_transcript", """
select conv_id, turn, upper(role[1]) || role[2:] as speaker, text from conversations where role <> 'system'""")
def session_transcript(fx: Fixtures):
    return C.transcript(fx.base("conversations"))


@query("session_upsert", """
select cast(conv_id as varchar) as session_id, arg_max(text, turn) as first_question, max(turn) as saved from conversations group by conv_id""")
def session_upsert(fx: Fixtures):
    """Each conversation saved once per speaker, the latest turn winning."""

    def saved(role: str):
        turns = fx.base("conversations").filter(F.col("role") == role)
        return turns.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(
            F.max_by("text", "turn").alias("first_question"), F.max("turn").alias("saved")
        )

    table = saved("system")
    for role in ("user", "assistant"):
        table = upsert_latest(table, saved(role), ["session_id"], "saved")
    return table


def _messages(fx: Fixtures):
    """Messages with tool calls, from the call table; every fifth conversation writes."""
    name = F.when(F.col("conv_id") % 5 == 0, F.lit("snapshot_create")).otherwise(F.lit("search"))
    call = F.array(
        F.struct(F.col("tool_call_id_made").alias("id"), name.alias("name"), F.lit("{}").alias("arguments"))
    )
    made = F.col("tool_call_id_made").isNotNull()
    return fx.table("fx_tool").select(
        "conv_id",
        "turn",
        F.when(made, F.lit("assistant")).when(F.col("tool_call_id_answered").isNotNull(), F.lit("tool")).otherwise(
            F.lit("user")
        ).alias("role"),
        F.when(made, call).alias("tool_calls"),
        F.col("tool_call_id_answered").alias("tool_call_id"),
    )


@query("tool_call_audit", """
select distinct conv_id, tool_call_id_made as tool_call_id from fx_tool m where tool_call_id_made is not null
  and not exists (select 1 from fx_tool a where a.conv_id = m.conv_id and a.tool_call_id_answered = m.tool_call_id_made)""")
def tool_call_audit(fx: Fixtures):
    return C.audit_tool_calls(_messages(fx))


@query("conversation_routing", """
select conv_id, count(tool_call_id_made) as rounds,
       case when count(tool_call_id_made) >= 12 or arg_max(coalesce(tool_call_id_made, ''), turn) = '' then 'end'
            when conv_id % 5 = 0 then 'approval' else 'tools' end as route
from fx_tool group by conv_id""")
def conversation_routing(fx: Fixtures):
    return C.route(_messages(fx))


_RULES = {"click": "last", "view": "sum", "purchase": "max", "signup": "min", "error": "ephemeral"}


@query("state_merge_reducers", """
select 'scalar' as part, thread_id, channel, cast(0 as bigint) as position,
       cast(case channel when 'click' then arg_max(value, step) when 'view' then sum(value) when 'purchase' then max(value)
            when 'signup' then min(value) when 'error' then
              case when max(step) = (select max(step) from fx_writes n where n.thread_id = w.thread_id) then arg_max(value, step) end end as bigint) as value
from fx_writes w group by thread_id, channel
union all
select 'append', thread_id, channel, row_number() over (partition by thread_id, channel order by step), value from fx_writes
union all
select 'union', thread_id, channel, row_number() over (partition by thread_id, channel order by step), value from
  (select thread_id, channel, value, min(step) as step from fx_writes group by thread_id, channel, value)
union all
select 'map', thread_id, channel, value % 10, arg_max(value, step) from fx_writes group by thread_id, channel, value % 10""")
def state_merge_reducers(fx: Fixtures):
    writes = fx.table("fx_writes")
    scalar = C.reduce_scalars(writes, _RULES).select(
        F.lit("scalar").alias("part"), "thread_id", "channel", F.lit(0).cast("long").alias("position"), "value"
    )
    lists = [
        df.select(F.lit(name).alias("part"), "thread_id", "channel", "position", "value")
        for name, df in (
            ("append", C.reduce_appends(writes)),
            ("union", C.reduce_unions(writes)),
            ("map", C.reduce_maps(writes.withColumn("key", F.col("value") % 10)).withColumnRenamed("key", "position")),
        )
    ]
    for rows in lists:
        scalar = scalar.unionByName(rows)
    return scalar


def _checkpoints(fx: Fixtures):
    return fx.table("fx_writes").select(
        F.concat_ws("-", "thread_id", "step").alias("id"), "thread_id", "step", "channel", "value"
    )


part("cps", "", "select cast(thread_id as varchar) || '-' || cast(step as varchar) as id, * from fx_writes")


@query("checkpoint_latest", """
select arg_max(id, step) as id, thread_id, max(step) as step, arg_max(channel, step) as channel, arg_max(value, step) as value
from cps group by thread_id""")
def checkpoint_latest(fx: Fixtures):
    return C.latest_checkpoint(_checkpoints(fx))


part("aged", "", "select *, row_number() over (partition by thread_id order by step desc) as age from cps")


@query("checkpoint_history", "select id, thread_id, step, channel, value, age from aged where age <= 5")
def checkpoint_history(fx: Fixtures):
    return C.checkpoint_history(_checkpoints(fx), 5)


@query("checkpoint_prune", """
select thread_id, count(*) filter (where age <= 3) as left_over, greatest(count(*) - 3, 0) as removed,
       min(step) filter (where age <= 3) as oldest from aged group by thread_id""")
def checkpoint_prune(fx: Fixtures):
    left, removed = C.checkpoint_prune(_checkpoints(fx), 3)
    kept = left.groupBy("thread_id").agg(F.count("*").alias("left_over"), F.min("step").alias("oldest"))
    return kept.join(removed, "thread_id")


@query("channel_versions", """
select thread_id, channel, step, row_number() over (partition by thread_id, channel order by step) as version from fx_writes""")
def channel_versions(fx: Fixtures):
    return C.channel_versions(fx.table("fx_writes"))


# --- ad-hoc SQL ----------------------------------------------------------------------------


@query("read_only_sql", """
select f.volume, split_part(f.path, '/', 1) as folder, count(*) as n, cast(sum(f.size) as bigint) as bytes
from paths f where not is_directory group by 1, 2""")
def read_only_sql(fx: Fixtures):
    adhoc.register(
        {
            "facts": S.facts(fx),
            "mutation_log": S.log(fx),
            "facts_with_path": tree.with_path(S.facts(fx), S.chain(fx)),
        }
    )
    return adhoc.read_only_sql(
        fx.spark,
        "select volume, split_part(path, '/', 1) as folder, count(*) as n, sum(size) as bytes "
        "from facts_with_path where not is_directory group by 1, 2;",
    )
