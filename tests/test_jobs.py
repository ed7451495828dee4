from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgertree import session
from ledgertree.functions import display as D
from ledgertree.operators import adhoc, attribution as A, bounds as B, conversation as C, history, maintain as M
from ledgertree.operators import snapshots as S
from ledgertree.functions import text
from ledgertree.operators.ordered import Ordered, as_of, hot_keys, join_unique
from ledgertree.schema import LIVE, PARENT_SNAPSHOTS, VOLUME_STATES
from ledgertree.sources import journal, listing, tables

T = datetime(2024, 1, 1)


def at(n):
    return T + timedelta(seconds=n)


def test_sizes_and_durations(spark):
    sizes = [0, 1023, 1024, 1152, 1536, 1 << 20, 3 << 30, 5 << 40, 258176]
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", D.human_size(F.col("s")).alias("t"))
    unit = {0: "B", 1: "KB", 2: "MB", 3: "GB", 4: "TB"}
    for r in df.collect():
        p = max(i for i in range(5) if i == 0 or r.s >= 1024**i)
        assert r.t == (f"{r.s} B" if p == 0 else f"{r.s / 1024**p:.2f} {unit[p]}")
    texts = {"30d": 2592000, "24h": 86400, "1min": 60, "7": 604800, "2 weeks": 1209600, "1m": 2592000, "0d": None,
             "d3": None, "3x": None, "": None, "1d2": None, "99999999999999999999d": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.duration_seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts


def test_displayable(spark):
    rows = [("Created", 0), ("Deleted", 0), ("Renamed", 0), ("Modified", 0), ("Modified", 1), ("Modified", -1),
            ("Modified", 2), ("Other", -2)]
    df = spark.createDataFrame(rows, "k string, d long").select(D.displayable(F.col("k"), F.col("d")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, True, False, False, False, True, True]


def test_look_back_splits_hot_keys(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else i % 50, i, rng.randint(0, 5) or None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    assert [r.k for r in hot_keys(df, ["k"], 100).collect()] == [0]
    assert hot_keys(df, ["k"], 10_000) is None
    cut = Ordered(df, ["k"], "o", 100)
    assert cut.split and cut.df.filter("_chunk is not null").select("k").distinct().count() == 1
    got = cut.look_back(last={"p": F.col("v")}, total={"n": F.lit(1)}).df
    last, count = {}, {}
    want = set()
    for k, o, v in rows:
        want.add((k, o, v, last.get(k), count.get(k, 0)))
        last[k] = v if v is not None else last.get(k)
        count[k] = count.get(k, 0) + 1
    assert {(r.k, r.o, r.v, r.p, r.n) for r in got.collect()} == want


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("chunk_rows", [20, 4_000_000])
def test_as_of(spark, forward, chunk_rows):
    rng = random.Random(11)
    left = [(i, rng.choice([1, 1, 1, 2]), at(rng.randint(0, 5000))) for i in range(300)]
    right = [(k, at(t)) for k in (1, 2, 3) for t in rng.sample(range(5000), 60)]
    got = as_of(
        spark.createDataFrame(left, "i long, k long, t timestamp"), spark.createDataFrame(right, "k long, u timestamp"),
        ("k", "t"), ("k", "u"), "near", forward, chunk_rows,
    )
    want = {}
    for i, k, t in left:
        fits = [u for kk, u in right if kk == k and (u >= t if forward else u <= t)]
        want[i] = (min(fits) if forward else max(fits)) if fits else None
    assert {r.i: r.near and r.near.u for r in got.collect()} == want


def test_sequences_are_dense_across_spans(spark):
    rng = random.Random(1)
    rows = [("C:" if rng.random() < 0.8 else "D:", i) for i in rng.sample(range(10_000), 600)]
    last = spark.createDataFrame([("C:", 40)], "volume string, last_sequence long")
    raw = spark.createDataFrame(rows, "volume string, usn long")
    for volume, first in (("C:", 41), ("D:", 1)):
        got = journal.assign_sequence(raw, last, span=50).filter(F.col("volume") == volume).orderBy("usn").collect()
        assert [r.sequence for r in got] == list(range(first, first + len(got)))


def test_classify_precedence(spark):
    cases = {0x200 | 0x100: "Deleted", 0x100 | 0x1000: "Created", 0x1000: "Renamed", 0x2000: "Renamed", 1: "Modified"}
    raw = spark.createDataFrame([(r, 16) for r in cases], "reason int, attributes int")
    got = {r.reason: r.kind for r in journal.classify_changes(raw).collect()}
    assert got == cases


def test_scan_merge_keeps_created_at(spark):
    ddl = "volume string, file_id long, size long, created_at timestamp"
    facts = spark.createDataFrame([("C:", 1, 5, at(0)), ("C:", 2, 6, at(0)), ("D:", 3, 7, at(0))], ddl)
    scan = spark.createDataFrame([("C:", 1, 9, at(5)), ("C:", 4, 1, at(5))], ddl)
    merged = {(r.file_id, r["size"], r.created_at) for r in listing.baseline_merge(facts, scan).collect()}
    assert merged == {(1, 9, at(0)), (2, 6, at(0)), (3, 7, at(0)), (4, 1, at(5))}
    purged = {r.file_id for r in listing.baseline_merge(facts, scan, purge=True).collect()}
    assert purged == {1, 3, 4}


def test_listing_of_real_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "deep").write_text("xx")
    (tmp_path / "a" / "top.txt").write_text("abc")
    found = listing.read_listing(spark, str(tmp_path))
    rel = found.withColumn("path", F.regexp_replace("path", f"^.*{tmp_path}/", ""))
    dotted = spark.createDataFrame([("a/b/.hidden", 2, T)], "path string, length long, modified_at timestamp")
    rows = {r["name"]: r for r in listing.inventory_from_paths(rel.unionByName(dotted), "C:").collect()}
    assert set(rows) == {"C:", "a", "b", "deep", ".hidden", "top.txt"}
    assert rows[".hidden"].attributes == 34 and rows["top.txt"]["size"] == 3 and rows["b"].is_directory
    assert rows["C:"].parent_file_id == rows["C:"].file_id and rows["top.txt"].parent_file_id == rows["a"].file_id


# --- attribution ---------------------------------------------------------------------------


def _live_sessions(events):
    """Footprints from start, stop, file and registry events taken one at a time."""
    active, installed, runtime, image = {}, set(), {}, {}
    for ts, kind, pid, ppid, name, event_id, path, data in events:
        if kind == "start":
            image[pid] = name
            root = next((k for k, s in active.items() if ppid in s["pids"]), None)
            if root is not None:
                active[root]["pids"].add(pid)
            elif any(m in name.lower() for m in A.INSTALLER_MARKS):
                active[pid] = {"pids": {pid}, "app": None, "files": set()}
        elif kind == "stop":
            for root, s in list(active.items()):
                if pid in s["pids"]:
                    s["pids"].remove(pid)
                    if not s["pids"]:
                        installed |= {(s["app"] or f"installer_{root}", f) for f in s["files"]}
                        del active[root]
            image.pop(pid, None)
        else:
            session = next((s for s in active.values() if pid in s["pids"]), None)
            if kind == "registry":
                if session:
                    session["app"] = data
            elif session:
                session["files"].add(path)
            elif event_id == 15 and pid in image and "documents/" in path.lower():
                if not any(m in image[pid].lower() for m in A.IGNORED_PROCESSES):
                    runtime[(image[pid], path)] = ts
    return installed, runtime


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_against_events_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    alive, procs, events, clock, serial = {}, {}, [], 0, 0
    for _ in range(500):
        clock += 1
        roll = rng.random()
        if roll < 0.25 or not alive:
            # Pids come back once their process is gone.
            pid = next((p for p in range(1, 40) if p not in alive))
            ppid = rng.choice([p for p in alive if p != pid] or [0])
            serial += 1
            name = rng.choice(["Setup.exe", "app.exe", "tool.exe", "explorer.exe", "updater.exe"])
            procs[serial] = [pid, ppid, name, at(clock), None]
            alive[pid] = serial
            events.append((at(clock), "start", pid, ppid, name, None, None, None))
        elif roll < 0.45:
            pid = rng.choice(list(alive))
            procs[alive.pop(pid)][4] = at(clock)
            events.append((at(clock), "stop", pid, None, None, None, None, None))
        elif roll < 0.55:
            events.append((at(clock), "registry", rng.choice(list(alive)), None, None, None, None, f"App{clock}"))
        else:
            path = f"C:/Users/Documents/f{rng.randint(0, 9)}"
            events.append((at(clock), "file", rng.choice(list(alive)), None, None, rng.choice([12, 15]), path, None))
    want_install, want_runtime = _live_sessions(events)
    processes = spark.createDataFrame(
        [tuple(p) for p in procs.values()], "pid long, ppid long, image string, started timestamp, stopped timestamp"
    )
    files = spark.createDataFrame(
        [(e[0], e[2], e[5], e[6]) for e in events if e[1] == "file"], "ts timestamp, pid long, event_id int, path string"
    )
    registry = spark.createDataFrame(
        [(e[0], e[2], "Software\\CurrentVersion\\Uninstall\\x", "DisplayName", e[7]) for e in events if e[1] == "registry"],
        "ts timestamp, pid long, key_name string, value_name string, data string",
    )
    members = A.session_members(processes, 20 if seed == 1 else 4_000_000).cache()
    got = {(r.app_name, r.file_path) for r in A.install_footprints(members, files, registry).collect()}
    assert got == want_install
    got = {(r.process_name, r.target_path): r.access_time for r in A.runtime_artifacts(members, files).collect()}
    assert got == want_runtime


def test_attribution_cascade(spark):
    install = spark.createDataFrame(
        [("Hollow Knight", "C:/Games/HK"), ("Launcher", "C:/Games"), ("Other", "C:/Gam")], "app_name string, file_path string"
    )
    runtime = spark.createDataFrame([("hk.exe", "C:/Users/u/AppData/LocalLow/HK")], "process_name string, target_path string")
    asked = ["C:\\Games\\HK\\data.bin", "C:/Games/x", "C:/GamesX", "C:/Users/u/AppData/LocalLow/HK/save", "D:/GLCache/1"]
    paths = spark.createDataFrame([(p,) for p in asked], "path string")
    got = {r.path: (r["name"], r["mode"]) for r in A.attribute(paths, install, runtime).collect()}
    assert got == {asked[0]: ("Hollow Knight", "install"), asked[1]: ("Launcher", "install"), asked[2]: (None, None),
                   asked[3]: ("hk.exe", "runtime"), asked[4]: (None, None)}
    texts = {r.path: r.explanation for r in A.explain_paths(paths, install, runtime).collect()}
    assert texts[asked[4]].startswith("GLCache is an NVIDIA") and texts[asked[2]].startswith("Unknown signature/path 'C:/GamesX'")


# --- snapshots, retention, conversations -------------------------------------------------------


def test_snapshot_rules(spark):
    log = spark.createDataFrame([("C:", 5)], "volume string, sequence long")
    facts = spark.createDataFrame([("C:", 1), ("D:", 2)], "volume string, file_id long")
    none = spark.createDataFrame([], PARENT_SNAPSHOTS)
    parents, children = S.create_snapshot(log, facts, none, T, " one ", ["c:"], snapshot_id="p1")
    assert parents.first().label == "one"
    assert [(r.volume, r.sequence_number, r.facts_count) for r in children.collect()] == [("C:", 5, 1)]
    for bad in ({"label": " "}, {"label": "one"}, {"volumes": ["X:"]}):
        with pytest.raises(S.SnapshotError):
            S.create_snapshot(log, facts, parents, T, **bad)
    with pytest.raises(S.SnapshotError):
        S.delete_snapshot(parents, children, "nope")
    left = S.delete_snapshot(parents, children, "one")
    assert left[0].isEmpty() and left[1].isEmpty()


def test_windows_and_history_checks(spark):
    log = spark.createDataFrame([("C:", 10, at(0)), ("C:", 11, at(86400 * 3))], "volume string, sequence long, at timestamp")
    late = spark.createDataFrame([("C:", 3, 11)], "volume string, start_seq long, end_seq long")
    with pytest.raises(B.WindowExpired):
        B.check_window(log, late)
    with pytest.raises(B.InsufficientHistory):
        B.check_history(log, at(-86400), at(86400 * 4))
    B.check_history(log, at(60), at(86400 * 4))
    assert B.in_window(log, late).count() == 2


def test_prune_skips_busy_volumes(spark):
    log = spark.createDataFrame([(v, i, at(i * 86400)) for v in ("C:", "D:", "E:") for i in range(4)],
                                "volume string, sequence long, at timestamp")
    states = spark.createDataFrame([("C:", "Live", False), ("D:", "Live", True)], VOLUME_STATES)
    kept, runs = M.retention_prune(log, states, timedelta(days=2), at(4 * 86400))
    assert {r.volume: r["count"] for r in kept.groupBy("volume").count().collect()} == {"C:": 2, "D:": 4, "E:": 4}
    assert {(r.volume, r.status) for r in runs.collect()} == {("C:", "SUCCESS"), ("D:", "SKIPPED")}
    assert runs.filter("volume = 'C:'").first().details.startswith("Deleted 2 rows older than 2024-01-03T")


def test_numbering_splits_hot_channels(spark):
    rng = random.Random(5)
    writes = [("t", "c" if rng.random() < 0.8 else "d", i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(writes, "thread_id string, channel string, step long, value long")
    lists, unions = {}, {}
    for _, channel, _, value in writes:
        lists.setdefault(channel, []).append(value)
        if value not in unions.setdefault(channel, []):
            unions[channel].append(value)
    for build, want in ((C.reduce_appends, lists), (C.reduce_unions, unions)):
        got = {}
        for r in build(df, 50).orderBy("channel", "position").collect():
            got.setdefault(r.channel, []).append(r.value)
        assert got == want


def test_reducers(spark):
    rows = [("t", "a", 1, 3), ("t", "a", 2, 1), ("t", "b", 3, 5), ("t", "e", 2, 7)]
    df = spark.createDataFrame(rows, "thread_id string, channel string, step long, value long")
    for rule, value in (("last", 1), ("sum", 4), ("max", 3), ("min", 1)):
        got = {r.channel: r.value for r in C.reduce_scalars(df, {"a": rule, "b": "ephemeral", "e": "ephemeral"}).collect()}
        assert got == {"a": value, "b": 5, "e": None}


def test_tool_calls_and_routes(spark):
    ddl = ("conv_id long, turn long, role string, tool_calls array<struct<id:string,name:string,arguments:string>>, "
           "tool_call_id string")
    call = [("call-1", "search", "{}")]
    write = [("call-2", "snapshot_create", "{}")]
    rows = [(1, 0, "assistant", call, None), (1, 1, "tool", None, "call-1"), (2, 0, "assistant", call, None),
            (3, 0, "assistant", write, None)] + [(4, t, "assistant", call, None) for t in range(12)]
    df = spark.createDataFrame(rows, ddl)
    assert {(r.conv_id, r.tool_call_id) for r in C.audit_tool_calls(df).collect()} == {(2, "call-1"), (3, "call-2"), (4, "call-1")}
    assert {r.conv_id: r.route for r in C.route(df).collect()} == {1: "end", 2: "tools", 3: "approval", 4: "end"}
    assert C.route(df, interactive=False).filter("conv_id = 3").first().route == "reject"


def test_checkpoints(spark):
    df = spark.createDataFrame([(f"{t}{s}", t, s) for t in "ab" for s in range(4)], "id string, thread_id string, step long")
    assert {r.id for r in C.latest_checkpoint(df).collect()} == {"a3", "b3"}
    assert [r.id for r in C.checkpoint_history(df, 2).filter("thread_id='a'").orderBy("age").collect()] == ["a3", "a2"]
    left, removed = C.checkpoint_prune(df, 3)
    assert left.count() == 6 and {r.thread_id: r.removed for r in removed.collect()} == {"a": 1, "b": 1}
    assert C.delete_thread(df, "a").count() == 4 and C.checkpoint_by_id(df, "b2").count() == 1


def test_only_queries_run(spark):
    adhoc.register({"t": spark.range(3)})
    assert adhoc.read_only_sql(spark, "with x as (select id from t) select sum(id) as s from x;").first().s == 3
    assert adhoc.read_only_json(spark, "select null as a, 1 as b").first().json == '{"a":null,"b":1}'
    for bad in ("drop view t", "create table x(a int)", "insert into t values (1)", "select 1; select 2",
                "with x as (select 1) insert into t select * from x", "set a=b"):
        with pytest.raises(Exception):
            adhoc.read_only_sql(spark, bad)


def test_sql_reads_registered_tables_only(spark, tmp_path):
    adhoc.register({"t": spark.range(3)})
    spark.range(2).createOrReplaceTempView("hidden")
    (tmp_path / "x").write_text("secret")
    for bad in (
        "select reflect('java.lang.System', 'getProperty', 'java.home')",
        "select java_method('java.lang.System', 'getProperty', 'java.home')",
        "select try_reflect('java.lang.System', 'getProperty', 'java.home')",
        f"select * from text.`{tmp_path}/x`", f"select 1 where exists (select * from text.`{tmp_path}/x`)",
        f"with t2 as (select * from text.`{tmp_path}/x`) select * from t2", "select * from hidden", "select * from t, hidden",
        "select transform(id) using 'cat' from t", "select (select max(id) from hidden)", "select * from identifier('hidden')",
        "select s1.id from hidden s1, (select 1 as a) hidden", "select hidden.id from hidden hidden", "select * from (select * from hidden) t",
        "select h.id from hidden h join (with hidden as (select 1 as id) select * from hidden) x on x.id = h.id",
    ):
        with pytest.raises(adhoc.NotAllowed):
            adhoc.read_only_sql(spark, bad)
    nested = "with a as (select id from t), b as (select * from a) select count(*) as n from b x join t on x.id = t.id"
    assert adhoc.read_only_sql(spark, nested).first().n == 3
    assert adhoc.read_only_sql(spark, "select 'reflect' as w from t where id in (select id from t)").count() == 3
    other = spark.newSession()
    other.range(9).createOrReplaceTempView("t")
    with pytest.raises(adhoc.NotAllowed):
        adhoc.read_only_sql(other, "select * from t")


def test_versions_of_log_and_facts(spark, tmp_path):
    root = str(tmp_path)
    facts = spark.createDataFrame([("C:", 1, 1, "C:"), ("D:", 2, 1, "x")], "volume string, file_id long, parent_file_id long, name string")
    for name in ("facts", "mutation_log"):
        with pytest.raises(LookupError):
            tables.current(spark, root, name)
        assert tables.publish(facts, root, name) == 1
        old = tables.current(spark, root, name)
        assert tables.publish(old.filter("volume = 'C:'"), root, name) == 2
        assert {r.volume for r in tables.current(spark, root, name).collect()} == {"C:"}
        assert old.count() == tables.current(spark, root, name, version=1).count() == 2
        assert tables.publish(old.filter("false"), root, name) == 3
        assert tables.current(spark, root, name).count() == 0
        # Another writer took number 4 meanwhile.
        assert tables._commit(spark, f"{root}/{name}/commits/4", "elsewhere")
        assert not tables._commit(spark, f"{root}/{name}/commits/4", "late")
        assert tables.publish(old, root, name) == 5


def test_writes_of_one_step_keep_their_order(spark):
    rows = [("t", "c", step, w, 10 * step + w) for step in range(4) for w in range(3)]
    for parts in (1, 4, 7):
        df = spark.createDataFrame(rows, "thread_id string, channel string, step long, write long, value long").repartition(parts)
        for chunk in (5, 4_000_000):
            got = [r.value for r in C.reduce_appends(df, chunk).orderBy("position").collect()]
            assert got == [r[4] for r in rows]
            versions = {(r.step, r.write): r.version for r in C.channel_versions(df, chunk).collect()}
            assert versions == {(s, w): 3 * s + w + 1 for _, _, s, w, _ in rows}
        assert C.reduce_scalars(df, {}).first().value == 32


def test_upsert_ties_and_missing_times(spark):
    ddl = "k long, at timestamp, v string"
    old = spark.createDataFrame([(1, at(5), "old"), (2, None, "old"), (3, at(9), "old")], ddl)
    new = spark.createDataFrame([(1, at(5), "new"), (2, None, "new"), (3, at(1), "new"), (4, None, "new")], ddl)
    got = {r.k: r.v for r in listing.upsert_latest(old, new, ["k"], "at").collect()}
    assert got == {1: "new", 2: "new", 3: "old", 4: "new"}


def test_scratch_is_gone_after_its_scope(spark):
    with session.scratch(spark) as folder:
        assert session.materialize(spark.range(5), "x").count() == 5
        assert session.files(spark, folder).exists(session.hadoop_path(spark, folder))
    assert not session.files(spark, folder).exists(session.hadoop_path(spark, folder))


def test_versions_of_a_table(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("C:", 1)], "volume string, last_sequence long")
    assert tables.publish(first, root, "drain_state") == 1
    old = tables.current(spark, root, "drain_state")
    assert tables.publish(old.withColumn("last_sequence", F.col("last_sequence") + 1), root, "drain_state") == 2
    assert tables.current(spark, root, "drain_state").first().last_sequence == 2


def test_history_report(spark):
    ddl = "volume string, sequence long, kind string, name string, size_delta long, at timestamp, renamed_from string"
    rows = [("C:", 1, "Created", "a", 2048, at(0), None), ("C:", 2, "Renamed", "b", 0, at(7200), "a"),
            ("C:", 3, "Renamed", "c", 0, at(7260), None)]
    got = history.history_report(spark.createDataFrame(rows, ddl), at(7290)).orderBy("sequence").collect()
    assert [(r.size_text, r.age, r.details) for r in got] == [
        ("+2.00 KB", "2h ago", ""), ("0 B", "1m ago", "Renamed from a"), ("0 B", "just now", "Renamed")]
    assert got[0].at_text == "2024-01-01 00:00:00"


def bound(monkeypatch, volumes):
    monkeypatch.setattr(B, "LITERAL_VOLUMES", volumes)


@pytest.mark.parametrize("volumes", [64, 1])
def test_volume_tables_mean_the_same_on_both_sides_of_the_bound(spark, monkeypatch, volumes):
    bound(monkeypatch, volumes)
    rows = [("C:", 1), ("C:", 5), ("D:", 2), ("E:", 3), (None, 4)]
    log = spark.createDataFrame(rows, "volume string, sequence long")
    cursors = spark.createDataFrame([("C:", 3), ("D:", 9), ("E:", None), (None, 7)], "volume string, last_sequence long")
    assert {tuple(r) for r in B.after_cursor(log, cursors).collect()} == {("C:", 5), ("E:", 3), (None, 4)}
    listed = cursors.select("volume").filter("volume <> 'E:'")
    assert {tuple(r) for r in B.drop_volumes(log, listed).collect()} == {("E:", 3), (None, 4)}
    spans = spark.createDataFrame([("C:", 1, 9), ("D:", 0, 2), (None, 0, 9)], "volume string, start_seq long, end_seq long")
    assert {tuple(r) for r in B.in_window(log, spans).collect()} == {("C:", 5), ("D:", 2)}
    states = spark.createDataFrame(
        [("C:", "BaselineScanning", False), ("D:", "Deleted", False), ("E:", LIVE, False)], "volume string, state string, replaying boolean"
    )
    marked = {(r.volume, r.volume_incomplete) for r in M.with_incomplete(log, states).collect()}
    assert marked == {("C:", True), ("D:", True), ("E:", False), (None, False)}


@pytest.mark.parametrize("volumes", [64, 1])
def test_prune_keeps_rows_without_time_or_volume(spark, monkeypatch, volumes):
    bound(monkeypatch, volumes)
    log = spark.createDataFrame(
        [("C:", 1, at(0)), ("C:", 2, None), ("C:", 3, at(90_000)), (None, 4, at(0)), ("D:", 5, at(0)), ("E:", 6, at(0)), ("F:", 7, at(0))],
        "volume string, sequence long, at timestamp",
    )
    states = spark.createDataFrame(
        [("C:", LIVE, False), ("D:", LIVE, True), ("E:", LIVE, False)], "volume string, state string, replaying boolean"
    )
    now = at(100_000)
    kept, runs = M.retention_prune(log, states, timedelta(seconds=50_000), now)
    assert {r.sequence for r in kept.collect()} == {2, 3, 4, 5, 7}
    assert {(r.volume, r.status, r.details.startswith("Deleted 1 ")) for r in runs.collect()} == {
        ("C:", "SUCCESS", True), ("D:", "SKIPPED", False), ("E:", "SUCCESS", True),
    }

    def broken(df):
        df.select(F.raise_error(F.lit("disk"))).collect()

    failed = M.prune(log, states, timedelta(seconds=50_000), now, broken)
    assert {(r.volume, r.status) for r in failed.collect()} == {("C:", "FAILED"), ("D:", "SKIPPED"), ("E:", "FAILED")}
    done = M.prune(log, states, timedelta(seconds=50_000), now, lambda df: df.collect())
    assert {r.status for r in done.collect()} == {"SUCCESS", "SKIPPED"}


def test_more_hot_keys_than_any_list_would_hold(spark):
    df = spark.range(36_000).selectExpr("id % 12000 as k", "id as o")
    assert hot_keys(df, ["k"], 2).count() == 12_000
    got = Ordered(df, ["k"], "o", 2).look_back(total={"n": F.lit(1)}).df
    assert got.groupBy("n").count().orderBy("n").collect() == [(0, 12_000), (1, 12_000), (2, 12_000)]


def test_chunks_follow_the_rows_and_not_the_time(spark):
    """Almost all rows of the hot key lie in one second of a long span."""
    rows = [(1, i if i < 950 else i * 1_000_000) for i in range(1000)] + [(2, 5)]
    df = spark.createDataFrame(rows, "k long, o long")
    cut = Ordered(df, ["k"], "o", 100)
    sizes = [r["count"] for r in cut.df.filter("_chunk is not null").groupBy("_chunk").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 200


@pytest.mark.parametrize("over", [5, 10_000])
def test_join_unique_splits_hot_keys(spark, over):
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(80)] + [(None, 99)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (2, "c"), (65, "d")], "k long, w string")
    for how in ("inner", "left"):
        got = join_unique(left, right, ["k"], how, over).select("k", "v", "w")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(
            map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str
        )


def test_as_of_keeps_machines_apart(spark):
    left = spark.createDataFrame([("m1", 7, at(10)), ("m2", 7, at(10))], "m string, pid long, t timestamp")
    right = spark.createDataFrame([("m1", 7, at(5)), ("m2", 7, at(8))], "m string, pid long, u timestamp")
    got = as_of(left, right, (("m", "pid"), "t"), (("m", "pid"), "u"), "near")
    assert {(r.m, r.near.u) for r in got.collect()} == {("m1", at(5)), ("m2", at(8))}


def test_long_tokens_are_kept(spark):
    name = "report " + "deadbeef" * 7 + " final.txt"
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(text.tokens(F.col("name"))).first()[0] == ["report", "deadbeef" * 7, "final", "txt"]


def test_signatures_from_a_table(spark):
    table = A.upsert_signatures(
        spark.createDataFrame([("a/b", "old"), ("zz", "z")], "key string, description string"),
        spark.createDataFrame([("a/b", "new"), ("a", "first")], "key string, description string"),
    )
    paths = spark.createDataFrame([("x\\A\\B",), ("zzz",), ("none",), (None,)], "path string")
    got = {r.path: r.description for r in A.match_signatures(paths, table).collect()}
    assert got == {"x\\A\\B": "first", "zzz": "z", "none": None, None: None}
    assert {r.description for r in A.match_signatures(paths, table.limit(0)).collect()} == {None}


def test_many_signatures_against_the_first_key_contained(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abC/\\é") for _ in range(n))
    keys = {word(rng.randint(1, 7)) for _ in range(300)} | {f"key{i:06d}/x" for i in range(30_000)}
    known = {k: f"about {k}" for k in keys}
    asked = [word(rng.randint(0, 25)) for _ in range(150)] + ["p/KEY000017\\X/y", "key029999", None, "", "ab"]
    table = spark.createDataFrame(sorted(known.items()), "key string, description string")
    paths = spark.createDataFrame([(p,) for p in asked] + [("ab",)], "path string")
    got = sorted(((r.path, r.description) for r in A.match_signatures(paths, table).collect()), key=str)

    def first(path):
        if path is None:
            return None
        text = path.replace("\\", "/").lower()
        return next((known[k] for k in sorted(known) if k.lower().replace("\\", "/") in text), None)

    assert got == sorted(((p, first(p)) for p in [*asked, "ab"]), key=str)
    with_all = table.unionByName(spark.createDataFrame([("", "all")], table.schema))
    assert {r.description for r in A.match_signatures(paths, with_all).collect()} == {"all", None}
    none = spark.createDataFrame([], "app_name string, file_path string, install_time timestamp")
    runs = spark.createDataFrame([], "process_name string, target_path string, access_time timestamp")
    texts = {r.path: r.explanation for r in A.explain_paths(paths, none, runs, table).collect()}
    assert all(texts[p] == first(p) for p in asked if first(p)) and len(texts) == len(set(asked))
