"""Plain sequential models and random inputs the operators are compared with."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)
KINDS = ["Created", "Modified", "Renamed", "Deleted"]

LOG_DDL = (
    "sequence long, volume string, file_id long, parent_file_id long, name string, kind string, is_directory boolean, "
    "observed_size long, size_delta long, at timestamp, source string"
)
FACT_DDL = (
    "volume string, file_id long, parent_file_id long, name string, is_directory boolean, size long, "
    "created_at timestamp, modified_at timestamp, attributes int"
)


def random_log(seed: int, files: int = 120, most: int = 12):
    """(facts rows, log rows): some files with a baseline fact, some without."""
    rng = random.Random(seed)
    facts, pending = [], []
    for f in range(1, files + 1):
        if rng.random() < 0.5:
            facts.append(("V:", f, 1000 + f % 3, f"base{f}", rng.random() < 0.1, rng.randint(0, 9), T0, T0, 32))
        pending += [f] * rng.randint(0, most)
    rng.shuffle(pending)
    log = []
    for seq, f in enumerate(pending, start=1):
        log.append(
            (seq, "V:", f, 1000 + rng.randint(0, 2), f"n{rng.randint(0, 2)}", rng.choice(KINDS), rng.random() < 0.1,
             rng.randint(-2, 9), rng.randint(-5, 5), T0 + timedelta(seconds=seq), "Watcher")
        )
    return facts, log


def replay(facts, log):
    """Facts and size changes, one row at a time."""
    state = {(r[0], r[1]): list(r) for r in facts}
    deltas = {}
    for seq, vol, fid, parent, name, kind, is_dir, observed, recorded, at, _ in log:
        key = (vol, fid)
        before = state[key][5] if key in state else 0
        if kind in ("Created", "Modified"):
            size = 0 if is_dir else max(observed, 0)
            deltas[seq] = 0 if is_dir else size - before
            created = state[key][6] if key in state else at
            state[key] = [vol, fid, parent, name, is_dir, size, created, at, 0]
        elif kind == "Deleted":
            deltas[seq] = 0 if is_dir else -before
            state.pop(key, None)
        else:
            deltas[seq] = recorded
            if key in state:
                state[key][2], state[key][3] = parent, name
    return {tuple(r) for r in state.values()}, deltas


def net_changes(log, start, end):
    """Net effect per file of the rows in (start, end]."""
    out, previous = {}, {}
    for seq, vol, fid, parent, name, kind, is_dir, _, delta, _, _ in log:
        old = previous.get(fid)
        previous[fid] = (name, parent)
        if not start < seq <= end:
            continue
        entry = out.get(fid)
        if entry is None:
            was = (old or (name, parent)) if kind == "Renamed" else (None, None)
            out[fid] = dict(kind=kind, name=name, parent=parent, is_dir=is_dir, delta=delta, old=was)
            continue
        if kind == "Created":
            entry.update(name=name, parent=parent, delta=entry["delta"] + delta)
            if entry["kind"] == "Deleted":
                entry["kind"] = "Modified"
        elif kind == "Modified":
            entry["delta"] += delta
        elif kind == "Renamed":
            entry.update(name=name, parent=parent)
            if entry["kind"] in ("Modified", "Deleted"):
                entry.update(kind="Renamed", old=old)
        elif entry["kind"] == "Created":
            del out[fid]
        else:
            entry.update(kind="Deleted", delta=entry["delta"] + delta)
    return {
        (fid, e["kind"], e["name"], e["parent"], e["is_dir"], e["delta"], *e["old"]) for fid, e in out.items()
    }


def merged_history(rows, collapse):
    """Consecutive rows of one item merged; rows are (sequence, file, parent, name, kind, delta)."""
    out = []
    for row in rows:
        seq, fid, parent, name, kind, delta = row
        if out:
            last = out[-1]
            same = last[4] == kind and last[1] == fid
            if same and (collapse or (last[3] == name and kind != "Modified")):
                out[-1] = (seq, fid, parent, name, kind, last[5] + delta)
                continue
        out.append(row)
    return out


def chain_up(parents, node):
    """Ancestors of a node until a root, a gap or a repeat."""
    out, seen = [], {node}
    current = parents.get(node)
    while current not in (None, 0) and current not in seen and current in parents:
        out.append(current)
        seen.add(current)
        current = parents[current]
    return out


def edit_distance(a, b):
    """Edits with neighbour swaps, no character edited twice."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]
