"""Which application put a file where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgertree.functions.text import prefixes, segments, slashes
from ledgertree.operators import tree
from ledgertree.operators.ordered import CHUNK_ROWS, as_of
from ledgertree.session import materialize
from ledgertree.sources.listing import upsert_latest

# What marks an installer image, a runtime folder, an ignored process.
INSTALLER_MARKS = ["setup", "install", "msiexec", "update"]
RUNTIME_FOLDERS = ["appdata/local", "appdata/roaming", "documents/"]
IGNORED_PROCESSES = ["explorer.exe", "svchost.exe", "chrome.exe", "firefox.exe", "msedge.exe"]
UNINSTALL_KEY, NAME_VALUE = "CurrentVersion/Uninstall", "DisplayName"
# File event numbers.
FILE_CREATE_EVENT, FILE_WRITE_EVENT = 12, 15

# Path substring -> description.
SIGNATURES = {
    "glcache": "GLCache is an NVIDIA shader cache; safe to delete.",
    "deriveddatacache": "DerivedDataCache is an Unreal Engine shader/asset cache; safe to delete.",
    "appdata/local/temp": "Temporary folder containing transient session files; safe to delete.",
    "tmp": "Temporary folder containing transient session files; safe to delete.",
    "steam": "Steam library or configuration files. Deleting this may uninstall games or disrupt client login.",
    "windows": "Critical operating system files. NEVER delete or mutate files in this directory.",
    "system32": "Critical operating system files. NEVER delete or mutate files in this directory.",
}
# Answers for a path.
INSTALL_TEXT = (
    "This path is an installation footprint of application '%s' (resolved dynamically via installer telemetry)."
)
RUNTIME_TEXT = (
    "This path is a runtime artifact generated by process '%s' (resolved dynamically via runtime telemetry)."
)
UNKNOWN_TEXT = (
    "Unknown signature/path '%s'. No installation or runtime footprints associated with this path."
)


def _has_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def session_members(processes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every process with the install session it belongs to, if any.

    ``processes``: pid, ppid, image, started, stopped (NULL while running). A
    child counts as such only when its parent was alive at its start, so reused
    pids do not mix. An installer image opens a session; children of members
    join it, whatever their image, so the session's root is the topmost
    installer above a process.
    """
    own = processes.select("*", F.xxhash64("pid", "started").alias("key"))
    linked = as_of(
        own.select("key", "ppid", "image", "started"),
        own.select("pid", "key", "started", "stopped"),
        ("ppid", "started"),
        ("pid", "started"),
        "parent",
        chunk_rows=chunk_rows,
    )
    alive = (F.col("parent.key") != F.col("key")) & (
        F.col("parent.stopped").isNull() | (F.col("started") <= F.col("parent.stopped"))
    )
    nodes = linked.select(
        F.lit("").alias("volume"),
        F.col("key").alias("file_id"),
        F.when(alive, F.col("parent.key")).alias("parent_file_id"),
        F.col("image").alias("name"),
    )
    installers = F.filter("visited", lambda a: _has_any(F.lower(a["name"]), INSTALLER_MARKS))
    roots = tree.chains(nodes).select(
        F.col("file_id").alias("key"), F.try_element_at(installers, F.lit(-1))["id"].alias("root_key")
    )
    return own.join(roots, "key")


def install_sessions(members: DataFrame) -> DataFrame:
    """One row per session; ``closed_at`` is NULL while a member still runs."""
    inside = members.filter("root_key is not null")
    root = F.col("key") == F.col("root_key")
    return inside.groupBy("root_key").agg(
        F.max(F.when(root, F.col("pid"))).alias("root_pid"),
        F.max(F.when(root, F.col("image"))).alias("image"),
        F.count("*").alias("members"),
        F.min("started").alias("opened_at"),
        F.when(F.count_if(F.col("stopped").isNull()) == 0, F.max("stopped")).alias("closed_at"),
    )


def _during(events: DataFrame, members: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Events with image and session of the process alive under their pid; others are dropped."""
    lives = members.select("pid", "image", "started", "stopped", "root_key")
    placed = as_of(events, lives, ("pid", "ts"), ("pid", "started"), "life", chunk_rows=chunk_rows)
    alive = F.col("life").isNotNull() & (F.col("life.stopped").isNull() | (F.col("ts") <= F.col("life.stopped")))
    return placed.filter(alive).select(*events.columns, "life.image", "life.root_key")


def install_footprints(members: DataFrame, file_events: DataFrame, registry_events: DataFrame) -> DataFrame:
    """(app_name, file_path, install_time) of closed sessions.

    The name is the last display name a member wrote to an uninstall key.
    """
    named = registry_events.filter(
        F.contains(slashes(F.col("key_name")), F.lit(UNINSTALL_KEY)) & (F.col("value_name") == NAME_VALUE)
    )
    names = (
        _during(named, members)
        .filter("root_key is not null")
        .groupBy("root_key")
        .agg(F.max_by("data", F.struct("ts", "data")).alias("display_name"))
    )
    closed = install_sessions(members).filter("closed_at is not null")
    apps = closed.join(names, "root_key", "left").select(
        "root_key",
        F.coalesce("display_name", F.concat(F.lit("installer_"), F.col("root_pid").cast("string"))).alias("app_name"),
        F.col("closed_at").alias("install_time"),
    )
    touched = file_events.filter(F.col("event_id").isin(FILE_CREATE_EVENT, FILE_WRITE_EVENT))
    files = _during(touched, members).filter("root_key is not null").select("root_key", F.col("path").alias("file_path")).distinct()
    return (
        files.join(apps, "root_key")
        .groupBy("app_name", "file_path")
        .agg(F.max("install_time").alias("install_time"))
    )


def runtime_artifacts(members: DataFrame, file_events: DataFrame) -> DataFrame:
    """(process_name, target_path, access_time) of writes to user folders outside sessions."""
    path = F.lower(slashes(F.col("path")))
    writes = file_events.filter((F.col("event_id") == FILE_WRITE_EVENT) & _has_any(path, RUNTIME_FOLDERS))
    outside = _during(writes, members).filter(
        F.col("root_key").isNull() & ~_has_any(F.lower("image"), IGNORED_PROCESSES)
    )
    return outside.groupBy(F.col("image").alias("process_name"), F.col("path").alias("target_path")).agg(
        F.max("ts").alias("access_time")
    )


def upsert_footprints(table: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_latest(table, new, ["app_name", "file_path"], "install_time")


def upsert_artifacts(table: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_latest(table, new, ["process_name", "target_path"], "access_time")


# --- paths to applications ------------------------------------------------------------------


def attribute(paths: DataFrame, install: DataFrame, runtime: DataFrame) -> DataFrame:
    """Each distinct path with the longest footprint equal to it or above it.

    Install footprints win over runtime ones. Paths are split into their
    whole-segment prefixes, so the prefix test is an equi-join against one row
    per footprint path.
    """
    known = (
        install.select(slashes(F.col("file_path")).alias("node"), F.lit(1).alias("rank"), F.col("app_name").alias("name"))
        .unionByName(
            runtime.select(
                slashes(F.col("target_path")).alias("node"), F.lit(0).alias("rank"), F.col("process_name").alias("name")
            )
        )
        .select(F.array_join(segments(F.col("node")), "/").alias("node"), "rank", "name")
        .groupBy("node")
        .agg(F.min_by(F.struct("rank", "name"), F.struct((-F.col("rank")).alias("r"), "name")).alias("best"))
    )
    spread = paths.select("path").distinct().select(
        "path", F.posexplode(prefixes(segments(F.col("path")))).alias("depth", "node")
    )
    hits = spread.join(known, "node").groupBy("path").agg(
        F.max_by(
            F.struct("best.name", "node"), F.struct("best.rank", "depth")
        ).alias("hit"),
        F.max("best.rank").alias("rank"),
    )
    return paths.select("path").distinct().join(hits, "path", "left").select(
        "path",
        F.col("hit.name").alias("name"),
        F.when(F.col("rank") == 1, F.lit("install")).when(F.col("rank") == 0, F.lit("runtime")).alias("mode"),
        F.col("hit.node").alias("footprint"),
    )


def signature_table(spark: SparkSession) -> DataFrame:
    """The fixed dictionary as a table (key, description)."""
    return spark.createDataFrame(sorted(SIGNATURES.items()), "key string, description string")


def upsert_signatures(table: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by key."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("description", "_new").alias("description"))


def signature(path: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Description under the first key, in key order, that the path contains."""
    known = sorted((SIGNATURES if dictionary is None else dictionary).items())
    if not known:
        return F.lit(None).cast("string")
    text = _compared(path)
    # One array in the plan, however many keys.
    keys = F.array(*[F.lit(key.lower().replace("\\", "/")) for key, _ in known])
    texts = F.array(*[F.lit(description) for _, description in known])
    hits = F.filter(F.arrays_zip(keys.alias("key"), texts.alias("description")), lambda s: F.contains(text, s["key"]))
    return F.try_element_at(hits, F.lit(1))["description"]


def _compared(text: Column) -> Column:
    return F.lower(slashes(text))


def _pieces(text: Column, sizes: Column | list[int]) -> Column:
    """Distinct stretches of the text of each of the sizes."""
    length, wanted = F.length(text), sizes if isinstance(sizes, Column) else F.array(*map(F.lit, sizes))

    def of_size(n: Column) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))))
        return F.coalesce(F.transform(starts, lambda i: F.substr(text, i, n)), F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(wanted, of_size)))


def match_signatures(paths: DataFrame, dictionary: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Each path with its description.

    A table of keys may be of any size: a key meets the paths by one of its triples of
    characters, the one that the fewest paths have, and is then compared in full. Keys of
    fewer characters meet the paths by themselves.
    """
    if not isinstance(dictionary, DataFrame):
        return paths.select("path", signature(F.col("path"), dictionary).alias("description"))
    texts = paths.filter("path is not null").select("path").distinct().select("path", _compared(F.col("path")).alias("text"))
    # Keys that compare alike are one; the first of them in key order counts.
    keys = dictionary.select("key", "description", _compared(F.col("key")).alias("want")).filter("want is not null")
    keys = keys.groupBy("want").agg(F.min(F.struct("key", "description")).alias("first"))
    size = F.least(F.length("want"), F.lit(3))
    offered = keys.select("want", "first", F.explode(_pieces(F.col("want"), F.array(size))).alias("piece"))
    spread = texts.select("path", "text", F.explode(_pieces(F.col("text"), [0, 1, 2, 3])).alias("piece"))
    # How many paths have a piece, among the pieces of keys.
    held = spread.join(offered.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = offered.join(held, "piece").groupBy("want").agg(
        F.min(F.struct("n", "piece")).alias("rarest"), F.min("first").alias("first")
    )
    rarest = materialize(rarest.select("want", "first", F.col("rarest.piece").alias("piece")), "rarest-pieces")
    met = spread.join(rarest, "piece").filter(F.contains("text", F.col("want")))
    found = met.groupBy(F.col("path").alias("of")).agg(F.min("first").alias("first"))
    return paths.join(found, F.col("path") == F.col("of"), "left").select("path", F.col("first.description").alias("description"))


def explain_paths(
    paths: DataFrame, install: DataFrame, runtime: DataFrame, dictionary: dict[str, str] | DataFrame | None = None
) -> DataFrame:
    """Text for each path: footprint, else signature, else unknown."""
    found = attribute(paths, install, runtime)
    if isinstance(dictionary, DataFrame):
        known = match_signatures(found.select("path"), dictionary).withColumnRenamed("path", "of")
        found = found.join(known, F.col("path").eqNullSafe(F.col("of")), "left")
        described = F.col("description")
    else:
        described = signature(F.col("path"), dictionary)
    text = (
        F.when(F.col("mode") == "install", F.format_string(INSTALL_TEXT, "name"))
        .when(F.col("mode") == "runtime", F.format_string(RUNTIME_TEXT, "name"))
        .otherwise(F.coalesce(described, F.format_string(UNKNOWN_TEXT, "path")))
    )
    return found.select("path", "mode", text.alias("explanation"))
