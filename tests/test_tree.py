from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from ledgertree.operators import history, rank, tree

NODE_DDL = "volume string, file_id long, parent_file_id long, name string, is_directory boolean, size long"
T = models.T0


def facts_of(spark, rows):
    df = spark.createDataFrame([("C:", *r) for r in rows], NODE_DDL)
    return df.withColumns({"created_at": F.lit(T), "modified_at": F.lit(T), "attributes": F.lit(0)})


@pytest.fixture(scope="module")
def rolled(spark):
    return facts_of(spark, [(1, 1, "C:", True, 0), (2, 1, "dir1", True, 0), (3, 2, "file1.txt", False, 100),
                            (4, 2, "file2.txt", False, 200), (5, 1, "file3.txt", False, 50)])


def test_rollup_and_files(rolled):
    chain = tree.chains(tree.directories(rolled))
    sums = {r["name"]: (r["size"], r["item_count"]) for r in tree.rollup_sizes(rolled, chain).collect()}
    assert sums == {"C:": (350, 3), "dir1": (300, 2)}
    top = rank.top(rolled, files=True).collect()
    assert [(r["size"], r["path"]) for r in top] == [(200, "dir1"), (100, "dir1"), (50, "")]


def test_root_left_out_and_nested_suppressed(spark):
    facts = facts_of(spark, [(1, 1, "C:", True, 0), (2, 1, "dir1", True, 0), (3, 2, "dir2", True, 0),
                             (4, 3, "file1.txt", False, 100), (5, 1, "file2.txt", False, 50)])
    below = rank.top(facts, folders=True, within=("C:", 1)).collect()
    assert [(r["name"], r["size"]) for r in below] == [("dir1", 100)]
    deeper = rank.top(facts, folders=True, within=("C:", 2)).collect()
    assert [(r["name"], r["size"], r["path"]) for r in deeper] == [("dir2", 100, "dir1")]


def test_odd_trees(spark):
    """A ring, an orphan, a root with parent 0, an empty folder."""
    facts = facts_of(spark, [(5, 6, "x", True, 0), (6, 5, "y", True, 0), (7, 99, "lost", True, 0),
                             (8, 0, "C:", True, 0), (9, 8, "empty", True, 0), (10, 6, "f", False, 3)])
    chain = tree.chains(tree.directories(facts))
    ups = {(r.file_id, r.ancestor_id, r.depth) for r in tree.closure(chain).collect()}
    assert ups == {(5, 6, 1), (6, 5, 1), (9, 8, 1)}
    assert {r.file_id for r in chain.filter("looped").collect()} == {5, 6}
    sums = {r.file_id: (r["size"], r["item_count"]) for r in tree.rollup_sizes(facts, chain).collect()}
    assert sums == {5: (3, 1), 6: (3, 1), 7: (0, 0), 8: (0, 0), 9: (0, 0)}
    paths = {r.file_id: r.path for r in tree.with_path(facts, chain).collect()}
    assert paths[7] == "lost" and paths[8] == "" and paths[9] == "empty"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_deep_random_trees(spark, seed):
    rng = random.Random(seed)
    parents = {1: 1}
    for n in range(2, 200):
        # Mostly chains, so that the depth passes 100.
        parents[n] = n - 1 if rng.random() < 0.9 else rng.randint(1, n - 1)
    facts = facts_of(spark, [(n, p, "C:" if n == 1 else f"d{n}", True, 0) for n, p in parents.items()])
    chain = tree.chains(tree.directories(facts))
    got = {}
    for r in tree.closure(chain).collect():
        got.setdefault(r.file_id, []).append((r.depth, r.ancestor_id))
    for n in parents:
        assert [a for _, a in sorted(got.get(n, []))] == models.chain_up(parents, n)


def test_suppression_equals_walking_the_ranking(spark):
    rng = random.Random(7)
    rows, nodes = [], []
    for t in range(40):
        size = rng.randint(2, 14)
        for n in range(1, size + 1):
            parent = n if n == 1 else rng.randint(1, n - 1)
            nodes.append((f"V{t}:", n, parent, f"d{n}"))
            rows.append((f"V{t}:", n, f"n{rng.randint(0, 3)}", rng.randint(0, 4)))
    chain = tree.chains(spark.createDataFrame(nodes, "volume string, file_id long, parent_file_id long, name string"))
    ranked = spark.createDataFrame(rows, "volume string, file_id long, name string, value long")
    got = {(r.volume, r.file_id) for r in rank.suppress_nested(ranked, chain).collect()}
    parents = {}
    for v, n, p, _ in nodes:
        parents.setdefault(v, {})[n] = p
    taken = set()
    for v, n, _, _ in sorted(rows, key=lambda r: (-r[3], r[2], -r[1], r[0])):
        if not any((v, a) in taken for a in models.chain_up(parents[v], n)):
            taken.add((v, n))
    assert got == taken


def test_pages_cover_a_ranking_with_ties(spark):
    rows = [("C:", i, None, f"n{i % 2}", True, 0, 0, 0, 0, i % 3) for i in range(20)]
    ddl = ("volume string, file_id long, parent_file_id long, name string, is_directory boolean, size long, "
           "size_delta long, churn long, item_count long, value long")
    ranked = spark.createDataFrame(rows, ddl)
    whole = [r.file_id for r in rank.page(ranked, 100).collect()]
    seen, cursor = [], None
    while True:
        got = rank.page(ranked, 6, cursor).collect()
        if not got:
            break
        seen += [r.file_id for r in got]
        cursor = rank.encode_cursor(got[-1])
    assert seen == whole and len(seen) == 20


def test_lookup_paths(spark):
    facts = facts_of(spark, [(1, 1, "C:", True, 0), (2, 1, "Docs", True, 0), (3, 2, "A.txt", False, 1)])
    gone = [(1, "C:", 9, 8, "old.txt", "Created", False, 1, 0, T, "Watcher"),
            (2, "C:", 8, 2, "Tmp", "Created", True, 0, 0, T, "Watcher"),
            (3, "C:", 7, 8, "old.txt", "Created", False, 1, 0, T, "Watcher"),
            (4, "C:", 6, 1, "top.txt", "Deleted", False, 0, 0, T, "Watcher")]
    log = spark.createDataFrame(gone, models.LOG_DDL)
    asked = ["c:\\docs\\a.TXT", "C:/", "C:", "c:/Docs/", "C:/docs/tmp/OLD.txt", "c:/top.txt", "C:/nope", "nodrive"]
    paths = spark.createDataFrame([(p,) for p in asked], "path string")
    for path, want in zip(asked, (3, 1, 1, 2, 7, 6)):
        assert tree.resolve_path(path, facts, log) == ("C:", want)
    for path in ("C:/nope", "nodrive"):
        with pytest.raises(LookupError):
            tree.resolve_path(path, facts, log)
    assert {r.sequence for r in history.for_path(log, facts, "c:/DOCS").collect()} == {2}
    assert {r.sequence for r in history.for_path(log, facts, "c:/docs/tmp/old.txt").collect()} == {3}
    chain = tree.chains(tree.directories(facts))
    got = {r.path: (r.file_id, r.found_in) for r in tree.lookup_paths(paths, facts, chain, log).collect()}
    assert got == {asked[0]: (3, "facts"), "C:/": (1, "facts"), "C:": (1, "facts"), "c:/Docs/": (2, "facts"),
                   asked[4]: (7, "log"), "c:/top.txt": (6, "log"), "C:/nope": (None, None), "nodrive": (None, None)}


def test_top_rejects_conflicting_options(rolled):
    for bad in ({"growth": True, "churn": True}, {"folders": True, "files": True}, {"since": T, "between": ("a", "b")}):
        with pytest.raises(ValueError):
            rank.top(rolled, **bad)


def test_subtree_is_strict(rolled):
    chain = tree.chains(tree.directories(rolled))
    assert {r.file_id for r in tree.subtree(rolled, chain, "C:", 2).collect()} == {3, 4}
    assert {r.file_id for r in tree.subtree(rolled, chain, "C:", 1).collect()} == {2, 3, 4, 5}


def test_diff_tree(spark):
    rows = [("C:", "C:/a/new.txt", "new.txt", "Created", 2048, None, 1), ("C:", "C:/a/b/gone", "gone", "Deleted", -1, None, 2),
            ("C:", "C:/z", "z", "Renamed", 0, "y", 3), ("D:", "D:/m", "m", "Modified", 5, None, 4)]
    ddl = "volume string, path string, name string, kind string, size_delta long, old_name string, file_id long"
    lines = tree.diff_tree(spark.createDataFrame(rows, ddl)).orderBy("volume", "sort_path").collect()
    assert [r.line for r in lines] == [
        "C:\\", "├── a/", "│   ├── b/", "│   │   └── - gone (-1 B)", "│   └── + new.txt (+2.00 KB)",
        "└── ~ z (Renamed from y, 0 B)", "D:\\", "└── ~ m (+5 B)"]


def test_chains_of_deleted_folders(spark):
    """Two levels of deleted folders, one renamed, and a ring only the log knows."""
    facts = facts_of(spark, [(1, 1, "C:", True, 0), (2, 1, "live", True, 0)])
    gone = [(1, "C:", 3, 2, "first", "Created", True, 0, 0, T, "W"), (2, "C:", 3, 2, "second", "Renamed", True, 0, 0, T, "W"),
            (3, "C:", 4, 3, "deep", "Deleted", True, 0, 0, T, "W"), (4, "C:", 5, 6, "r5", "Deleted", True, 0, 0, T, "W"),
            (5, "C:", 6, 5, "r6", "Deleted", True, 0, 0, T, "W"), (6, "C:", 9, 4, "f", "Deleted", False, 0, 0, T, "W")]
    log = spark.createDataFrame(gone, models.LOG_DDL)

    def paths(ids, chain=None):
        wanted = spark.createDataFrame([("C:", i) for i in ids], "volume string, file_id long")
        known = tree.known_chains(wanted, facts, log, chain)
        return {r.file_id: r.dir_path for r in tree.directory_paths(known).collect()}

    got = paths([4, 5, 77])
    assert got[4] == "live/second/deep" and got[3] == "live/second" and got[5] == "r6/r5" and 77 not in got
    kept = tree.chains(tree.directories(facts))
    assert paths([2], kept) == {1: "", 2: "live"}


def test_rechain_walks_only_the_changed_part(spark):
    rng = random.Random(8)
    rows = [("C:", 1, 1, "C:")] + [("C:", i, rng.randint(1, i - 1), f"d{i}") for i in range(2, 200)] + [("D:", 1, 1, "D:"), ("D:", 2, 1, "x")]
    schema = "volume string, file_id long, parent_file_id long, name string"
    before = spark.createDataFrame(rows, schema)
    chain = tree.chains(before)
    moved = {150: (3, "moved"), 40: (2, "d40"), 300: (40, "new"), 301: (300, "newer"), 7: (1, "renamed")}
    after = [r for r in rows if r[0] == "D:" or r[1] not in moved] + [("C:", i, p, n) for i, (p, n) in moved.items()]
    nodes = spark.createDataFrame(after, schema)
    changed = spark.createDataFrame([("C:", i) for i in moved], "volume string, file_id long")
    got = {(r.volume, r.file_id): tuple(a.id for a in r.visited) + (r.looped,) for r in tree.rechain(chain, nodes, changed).collect()}
    want = {(r.volume, r.file_id): tuple(a.id for a in r.visited) + (r.looped,) for r in tree.chains(nodes).collect()}
    assert got == want
    stale = tree.below(chain, changed).count()
    assert 3 <= stale < 200


def test_asked_paths_are_worked_out_once(spark, rolled, tmp_path):
    asked = str(tmp_path / "asked")
    spark.createDataFrame([("C:/dir1/file1.txt",), ("C:/dir1/gone.txt",), ("C:/none",)], "path string").write.parquet(asked)
    log = spark.createDataFrame([(1, "C:", 9, 2, "gone.txt")], "sequence long, volume string, file_id long, parent_file_id long, name string")
    found = tree.lookup_paths(spark.read.parquet(asked), rolled, tree.chains(tree.directories(rolled)), log)
    assert {(r.path, r.file_id, r.found_in) for r in found.collect()} == {
        ("C:/dir1/file1.txt", 3, "facts"), ("C:/dir1/gone.txt", 9, "log"), ("C:/none", None, None),
    }
    assert not any(f.endswith("/asked") or "/asked/" in f for f in found.inputFiles())
