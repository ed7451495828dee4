"""Sources, ingestion and state reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertree.operators import replay, search, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.registry import part, query, stamp
from ledgertree.schema import RAW_CHANGES
from ledgertree.session import new_path
from ledgertree.sources import journal, listing, tables
from ledgertree.streaming import ingest as ingest_streaming
from ledgertree.streaming import replay as replay_streaming

FACT_TEXT = (
    f"volume, file_id, parent_file_id, name, is_directory, size, {stamp('created_at')} as created_at, "
    f"{stamp('modified_at')} as modified_at, cast(attributes as bigint) as attributes"
)

part("path_parts", "", """
 select [x for x in string_split(path, '/') if x <> ''] as parts, length,
        timestamp '2024-01-01 00:00:00' + to_seconds(page_id) as modified_at from fx_paths""")
part("path_nodes", "", """
 select array_to_string(parts[1:i], '/') as path, i = len(parts) as is_file, length, modified_at
 from (select parts, length, modified_at, unnest(range(0, len(parts) + 1)) as i from path_parts)""")


@query("inventory_from_paths", f"""
select path, case when path = '' then 'W:' else string_split(path, '/')[-1] end as name,
       bool_or(not is_file) as is_directory,
       case when bool_or(not is_file) then 0 else max(case when is_file then length end) end as size,
       {stamp('max(modified_at)')} as modified_at,
       cast(case when bool_or(not is_file) then 16 else 32 end
            + case when path <> '' and string_split(path, '/')[-1][1] = '.' then 2 else 0 end as bigint) as attributes
from path_nodes group by path""")
def inventory_from_paths(fx: Fixtures):
    files = fx.table("fx_paths").select(
        "path", "length", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("modified_at")
    )
    found = fx.keep("inventory", lambda: listing.inventory_from_paths(files, "W:"))
    paths = tree.with_path(found, tree.chains(tree.directories(found)))
    return paths.select("path", "name", "is_directory", "size", "modified_at", "attributes")


_SCANNED = ["C:", "D:", "E:"]


def _scan(fx: Fixtures):
    return S.replayed(fx).filter(F.col("volume").isin(_SCANNED))


part("scan", "", "select * from replayed where volume in ('C:', 'D:', 'E:')")
_MERGED = """
select coalesce(s.volume, f.volume) as volume, coalesce(s.file_id, f.file_id) as file_id,
       case when s.file_id is null then f.parent_file_id else s.parent_file_id end as parent_file_id,
       case when s.file_id is null then f.name else s.name end as name,
       case when s.file_id is null then f.is_directory else s.is_directory end as is_directory,
       case when s.file_id is null then f.size else s.size end as size,
       coalesce(f.created_at, s.created_at) as created_at,
       case when s.file_id is null then f.modified_at else s.modified_at end as modified_at,
       case when s.file_id is null then f.attributes else s.attributes end as attributes,
       s.file_id is not null as visited
from fx_facts f full join scan s on s.volume = f.volume and s.file_id = f.file_id"""
part("merged", "", _MERGED)


@query("baseline_merge_upsert", f"select {FACT_TEXT} from merged")
def baseline_merge_upsert(fx: Fixtures):
    return listing.baseline_merge(S.facts(fx), _scan(fx))


@query("baseline_purge_unvisited",
       f"select {FACT_TEXT} from merged where visited or volume not in (select volume from scan)")
def baseline_purge_unvisited(fx: Fixtures):
    return listing.baseline_merge(S.facts(fx), _scan(fx), purge=True)


part("classified", "", """
 select usn, chr(cast(67 + file_ref % 5 as integer)) || ':' as volume, file_ref,
        case when reason & 512 <> 0 then 'Deleted' when reason & 256 <> 0 then 'Created'
             when reason & 12288 <> 0 then 'Renamed' else 'Modified' end as kind,
        attributes & 16 <> 0 as is_directory from fx_raw""")


def _raw(fx: Fixtures):
    raw = fx.table("fx_raw").select(
        "usn",
        F.concat(F.chr(F.lit(67) + F.col("file_ref") % 5), F.lit(":")).alias("volume"),
        "file_ref",
        F.lit(None).cast("long").alias("parent_ref"),
        F.lit(None).cast("string").alias("name"),
        F.col("reason").cast("int").alias("reason"),
        F.col("attributes").cast("int").alias("attributes"),
        "at",
    )
    return raw.to(RAW_CHANGES)


@query("change_ingest_kind", "select usn, volume, file_ref, kind, is_directory from classified")
def change_ingest_kind(fx: Fixtures):
    return journal.classify_changes(_raw(fx)).select("usn", "volume", "file_ref", "kind", "is_directory")


@query("change_ingest_stream", """
select row_number() over (partition by volume order by usn) as sequence, usn, volume, file_ref, kind, is_directory
from classified""")
def change_ingest_stream(fx: Fixtures):
    raw, spark = _raw(fx), fx.spark
    source, sink = new_path(spark, "journal"), new_path(spark, "ingested")
    end = raw.agg(F.max("usn")).first()[0]
    for third in range(3):
        low, high = end * third // 3, end * (third + 1) // 3
        piece = raw.filter((F.col("usn") > (low if third else -1)) & (F.col("usn") <= high))
        piece.coalesce(1).write.mode("append").parquet(source)
    stream = ingest_streaming.read_journal(spark, source, files_per_trigger=1)
    ingest_streaming.ingest_stream(stream, sink, new_path(spark, "progress")).awaitTermination()
    return ingest_streaming.read_log(spark, sink).select("sequence", "usn", "volume", "file_ref", "kind", "is_directory")


@query("log_sequence_assign", """
select row_number() over (partition by c.volume order by usn) + coalesce(e.last_sequence, 0) as sequence, usn, c.volume
from classified c left join (select volume, max(sequence) as last_sequence from fx_log group by volume) e
  on e.volume = c.volume""")
def log_sequence_assign(fx: Fixtures):
    last = S.raw_log(fx).groupBy("volume").agg(F.max("sequence").alias("last_sequence"))
    return journal.assign_sequence(_raw(fx), last).select("sequence", "usn", "volume")


@query("footprint_upsert", f"""
select 'app_' || cast(pid as varchar) as app_name, path as file_path, {stamp('max(ts)')} as install_time
from fx_file_ev group by pid, path""")
def footprint_upsert(fx: Fixtures):
    def seen(event_id: int):
        return (
            fx.table("fx_file_ev").filter(F.col("event_id") == event_id)
            .groupBy(F.concat(F.lit("app_"), F.col("pid").cast("string")).alias("app_name"), F.col("path").alias("file_path"))
            .agg(F.max("ts").alias("install_time"))
        )

    return listing.upsert_latest(seen(12), seen(15), ["app_name", "file_path"], "install_time")


@query("rows_to_json", """
select cast(to_json({'conv_id': conv_id, 'turn': turn, 'tool_call_id_made': tool_call_id_made,
                'tool_call_id_answered': tool_call_id_answered}) as varchar) as json from fx_tool""")
def rows_to_json(fx: Fixtures):
    return tables.to_json_rows(fx.table("fx_tool"))


@query("table_io", f"select {FACT_TEXT} from fx_facts where volume <> 'C:'")
def table_io(fx: Fixtures):
    """Two published versions, the second without one volume; readers take the second."""
    root = new_path(fx.spark, "tables")
    tables.publish(S.facts(fx), root, "facts")
    tables.publish(tables.current(fx.spark, root, "facts").filter("volume <> 'C:'"), root, "facts")
    return tables.current(fx.spark, root, "facts")


# --- state reduction ---------------------------------------------------------------------


@query("replay_facts", f"select {FACT_TEXT} from replayed")
def replay_facts(fx: Fixtures):
    return replay.replay(S.facts(fx), S.raw_log(fx))


LOG_TEXT = f'''sequence, volume, file_id, parent_file_id, name, kind, is_directory, size_delta, {stamp('"at"')} as "at", source'''
LOG_COLUMNS = ["sequence", "volume", "file_id", "parent_file_id", "name", "kind", "is_directory", "size_delta", "at", "source"]


@query("size_delta_correction", f"select {LOG_TEXT} from logc")
def size_delta_correction(fx: Fixtures):
    return replay.correct_deltas(S.facts(fx), S.raw_log(fx)).select(*LOG_COLUMNS)


@query("drain_cursor_resume", """
select f.volume, f.files, f.bytes, e.last_sequence from
 (select volume, count(*) as files, cast(sum(size) as bigint) as bytes from from_half group by volume) f
 left join (select volume, max(sequence) as last_sequence from fx_log group by volume) e on e.volume = f.volume""")
def drain_cursor_resume(fx: Fixtures):
    cursors = S.start_cursors(fx)
    after = replay.replay(S.facts(fx), S.raw_log(fx), cursors)
    moved = replay.advance_cursors(S.raw_log(fx), cursors)
    per = after.groupBy("volume").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return per.join(moved, "volume", "left")


part("half_scan", "", "select * from at_half where volume in ('C:', 'D:', 'E:')")
part("half_facts", "", """
 select s.volume, s.file_id, s.parent_file_id, s.name, s.is_directory, s.size,
        coalesce(f.created_at, s.created_at) as created_at, s.modified_at, s.attributes
 from half_scan s left join fx_facts f on f.volume = s.volume and f.file_id = s.file_id
 union all
 select * from fx_facts where volume not in ('C:', 'D:', 'E:')""")
S.fold_parts("reconciled", "half_facts", "log_tail")


@query("baseline_reconcile", f"select {FACT_TEXT} from reconciled")
def baseline_reconcile(fx: Fixtures):
    half = S.log_end(fx) // 2
    seen = replay.replay(S.facts(fx), S.raw_log(fx).filter(F.col("sequence") <= half))
    scan = seen.filter(F.col("volume").isin(_SCANNED))
    return replay.reconcile(S.facts(fx), scan, S.raw_log(fx), S.start_cursors(fx))


@query("replay_stream", "select volume, file_id, sequence, kind, size_delta from logc")
def replay_stream(fx: Fixtures):
    spark = fx.spark
    source, sink = new_path(spark, "log"), new_path(spark, "replayed")
    log, half = S.raw_log(fx), S.log_end(fx) // 2
    for piece in (log.filter(F.col("sequence") <= half), log.filter(F.col("sequence") > half)):
        piece.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    replay_streaming.replay_stream(stream, S.facts(fx), sink, new_path(spark, "progress")).awaitTermination()
    return replay_streaming.corrected_log(spark, sink).select("volume", "file_id", "sequence", "kind", "size_delta")


@query("search_index_sync", """
select volume || '-' || cast(f.file_id as varchar) as uid, f.volume, f.name, coalesce(d.dir_path, '') as path,
       lower(regexp_extract(f.name, '^.+\\.([^.]*)$', 1)) as ext, f.size, cast(floor(epoch(f.modified_at)) as bigint) as modified_at
from replayed f left join (select volume as v, file_id as parent, dir_path from dirpath) d on d.v = f.volume and d.parent = f.parent_file_id""")
def search_index_sync(fx: Fixtures):
    changed = S.raw_log(fx).select("volume", "file_id")
    docs = search.sync_documents(S.documents(fx), S.replayed(fx), changed, S.chain(fx))
    return docs.select("uid", "volume", "name", "path", "ext", "size", F.floor("modified_at").alias("modified_at"))
