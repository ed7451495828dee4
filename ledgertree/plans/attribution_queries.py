"""Files to applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertree.operators import attribution as A
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.registry import part, query, stamp
from ledgertree.session import new_path
from ledgertree.streaming import attribution as A_stream

part("links", "", """
 select c.pid, p.pid as parent from fx_proc c join fx_proc p on p.pid = c.ppid and p.pid <> c.pid
  and c.started >= p.started and c.started <= p.stopped""")
part("above", "(pid, node, depth)", """
 select pid, pid, 0 from fx_proc
 union all
 select a.pid, l.parent, a.depth + 1 from above a join links l on l.pid = a.node""")
part("member", "", """
 select a.pid, arg_max(a.node, a.depth) as root from above a join fx_proc p on p.pid = a.node
 where regexp_matches(lower(p.image), 'setup|install|msiexec|update') group by a.pid""")
part("inst", "", """
 select m.root as root_pid, count(*) as members, min(p.started) as opened_at, max(p.stopped) as closed_at
 from member m join fx_proc p on p.pid = m.pid group by m.root""")


def _members(fx: Fixtures):
    return fx.keep("members", lambda: A.session_members(fx.table("fx_proc")))


@query("install_sessions", f"""
select s.root_pid, p.image, members, {stamp('opened_at')} as opened_at, {stamp('closed_at')} as closed_at
from inst s join fx_proc p on p.pid = s.root_pid""")
def install_sessions(fx: Fixtures):
    return A.install_sessions(A.session_members(fx.table("fx_proc"))).drop("root_key")


part("live_files", "", """
 select e.*, p.image, m.root from fx_file_ev e join fx_proc p on p.pid = e.pid and e.ts >= p.started and e.ts <= p.stopped
 left join member m on m.pid = p.pid""")
part("display", "", """
 select m.root, arg_max(r.data, struct_pack(a := r.ts, b := r.data)) as app from fx_reg_ev r
 join fx_proc p on p.pid = r.pid and r.ts >= p.started and r.ts <= p.stopped join member m on m.pid = p.pid group by m.root""")
part("installed", "", """
 select coalesce(d.app, 'installer_' || cast(s.root_pid as varchar)) as app_name, f.path as file_path, max(s.closed_at) as install_time
 from live_files f join inst s on s.root_pid = f.root left join display d on d.root = f.root
 where f.event_id in (12, 15) group by 1, 2""")
part("artifacts", "", """
 select image as process_name, path as target_path, max(ts) as access_time from live_files
 where root is null and event_id = 15 and regexp_matches(lower(path), 'appdata/local|appdata/roaming|documents/')
   and not regexp_matches(lower(image), 'explorer\\.exe|svchost\\.exe|chrome\\.exe|firefox\\.exe|msedge\\.exe')
 group by image, path""")


def _install(fx: Fixtures):
    return fx.keep(
        "install", lambda: A.install_footprints(_members(fx), fx.table("fx_file_ev"), fx.table("fx_reg_ev"))
    )


def _runtime(fx: Fixtures):
    return fx.keep("runtime", lambda: A.runtime_artifacts(_members(fx), fx.table("fx_file_ev")))


@query("install_footprints", f"select app_name, file_path, {stamp('install_time')} as install_time from installed")
def install_footprints(fx: Fixtures):
    return A.install_footprints(_members(fx), fx.table("fx_file_ev"), fx.table("fx_reg_ev"))


@query("runtime_artifacts", f"select process_name, target_path, {stamp('access_time')} as access_time from artifacts")
def runtime_artifacts(fx: Fixtures):
    return A.runtime_artifacts(_members(fx), fx.table("fx_file_ev"))


# Every written path, one level below it, its folder, and the crawled pages' paths.
part("targets", "", """
 select distinct path from (
  select path from fx_file_ev union all select path || '/cache.bin' from fx_file_ev
  union all select regexp_replace(path, '/[^/]*$', '') from fx_file_ev union all select 'E:/Steam/' || path from fx_paths
  union all select path from fx_paths)""")


def _targets(fx: Fixtures):
    files, pages = fx.table("fx_file_ev"), fx.table("fx_paths")
    path = F.col("path")
    rows = files.select("path")
    for more in (
        files.select(F.concat(path, F.lit("/cache.bin")).alias("path")),
        files.select(F.regexp_replace(path, "/[^/]*$", "").alias("path")),
        pages.select(F.concat(F.lit("E:/Steam/"), path).alias("path")),
        pages.select("path"),
    ):
        rows = rows.unionByName(more)
    return rows.distinct()


part("known", "", """
 select file_path as path, 1 as rank, app_name as name from installed
 union all select target_path, 0, process_name from artifacts""")
part("owned", "", """
 select path, name, rank, node from (
  select t.path, k.name, k.rank, k.path as node,
         row_number() over (partition by t.path order by k.rank desc, length(k.path) desc, k.name) as r
  from targets t join known k on k.path = t.path or starts_with(t.path, k.path || '/')) where r = 1""")


@query("footprint_prefix_join", """
select t.path, o.name, case o.rank when 1 then 'install' when 0 then 'runtime' end as mode, o.node as footprint
from targets t left join owned o on o.path = t.path""")
def footprint_prefix_join(fx: Fixtures):
    return A.attribute(_targets(fx), _install(fx), _runtime(fx))


def _signature_sql(column: str) -> str:
    cases = " ".join(
        f"when contains(lower({column}), '{key}') then '{text}'" for key, text in sorted(A.SIGNATURES.items())
    )
    return f"case {cases} end"


@query("signature_match", f"select path, {_signature_sql('path')} as description from targets")
def signature_match(fx: Fixtures):
    return A.match_signatures(_targets(fx), A.signature_table(fx.spark))


def _text_sql(template: str, column: str) -> str:
    head, tail = template.replace("'", "''").split("%s")
    return f"'{head}' || {column} || '{tail}'"


@query("attribution_cascade", f"""
select t.path, case o.rank when 1 then 'install' when 0 then 'runtime' end as mode,
       case o.rank when 1 then {_text_sql(A.INSTALL_TEXT, 'o.name')} when 0 then {_text_sql(A.RUNTIME_TEXT, 'o.name')}
            else coalesce({_signature_sql('t.path')}, {_text_sql(A.UNKNOWN_TEXT, 't.path')}) end as explanation
from targets t left join owned o on o.path = t.path""")
def attribution_cascade(fx: Fixtures):
    return A.explain_paths(_targets(fx), _install(fx), _runtime(fx))


@query("footprint_streaming", f"""
select 'install' as mode, app_name as name, file_path as path, {stamp('install_time')} as at_time from installed
union all
select 'runtime' as mode, process_name, target_path, {stamp('access_time')} from artifacts""")
def footprint_streaming(fx: Fixtures):
    spark = fx.spark
    procs = fx.table("fx_proc")
    parts = [
        procs.select(F.lit("start").alias("type"), F.col("started").alias("ts"), "pid", "ppid", "image"),
        procs.select(F.lit("stop").alias("type"), F.col("stopped").alias("ts"), "pid"),
        fx.table("fx_file_ev").select(F.lit("file").alias("type"), "ts", "pid", "event_id", "path"),
        fx.table("fx_reg_ev").select(F.lit("registry").alias("type"), "ts", "pid", "key_name", "value_name", "data"),
    ]
    events = parts[0]
    for more in parts[1:]:
        events = events.unionByName(more, allowMissingColumns=True)
    # Columns missing everywhere so far take the schema's type.
    events = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in A_stream.EVENTS])
    events = fx.keep("events", lambda: events)
    source, sink = new_path(spark, "events"), new_path(spark, "attributed")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    for piece in (events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)):
        piece.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(A_stream.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    A_stream.attribution_stream(stream, sink, new_path(spark, "progress")).awaitTermination()
    install, runtime = A_stream.install_table(spark, sink), A_stream.runtime_table(spark, sink)
    return install.select(
        F.lit("install").alias("mode"), F.col("app_name").alias("name"), F.col("file_path").alias("path"),
        F.col("install_time").alias("at_time"),
    ).unionByName(
        runtime.select(
            F.lit("runtime").alias("mode"), F.col("process_name").alias("name"), F.col("target_path").alias("path"),
            F.col("access_time").alias("at_time"),
        )
    )
