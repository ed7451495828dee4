"""Parent-pointer trees: ancestor chains, paths, rollups and display trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.functions.display import human_delta
from ledgertree.functions.text import after_drive, ascii_lower, drive_of, prefixes, segments
from ledgertree.schema import CREATED, DELETED, RENAMED
from ledgertree.session import materialize

# Doublings planned together before the result is written.
DOUBLINGS = 2


def directories(facts: DataFrame) -> DataFrame:
    return facts.filter("is_directory").select("volume", "file_id", "parent_file_id", "name")


def chains(nodes: DataFrame) -> DataFrame:
    """One row per node with ``visited``: the node itself, its parent, and so on up.

    The walk stops at a self-parent, at parent 0, at a missing parent or before
    a node it has already visited (``looped``). Each element carries ``id``,
    ``name`` and ``top`` (self-parented, or named as the volume).

    Every round joins the table with itself and doubles the walked length, so a
    tree of depth d takes log2(d) joins. ``nodes`` holds directories only and is
    unique by (volume, file_id); one side of the join is therefore unique, and a
    directory with very many children is split by the adaptive skew join.
    """
    return _finished(_walks(nodes))


def _walks(nodes: DataFrame) -> DataFrame:
    """Walks of one node each."""
    top = (F.col("parent_file_id") == F.col("file_id")) | (
        (F.col("name") == F.col("volume")) | (F.concat("name", F.lit(":")) == F.col("volume"))
    )
    return nodes.select(
        "volume",
        "file_id",
        F.array(F.struct(F.col("file_id").alias("id"), "name", top.alias("top"))).alias("visited"),
        F.when(
            (F.col("parent_file_id") != F.col("file_id")) & (F.col("parent_file_id") != 0),
            F.col("parent_file_id"),
        ).alias("next"),
        F.lit(False).alias("looped"),
    )


def _finished(walk: DataFrame) -> DataFrame:
    while True:
        for _ in range(DOUBLINGS):
            walk = _double(walk)
        walk = materialize(walk, "chains")
        if walk.filter("next is not null").isEmpty():
            return walk.drop("next")


def below(chain: DataFrame, folders: DataFrame) -> DataFrame:
    """(volume, file_id) of the chains that lead past one of ``folders``, itself included."""
    keys = ["volume", "file_id"]
    steps = chain.select("volume", F.col("file_id").alias("_at"), F.explode("visited.id").alias("file_id"))
    return steps.join(folders.select(*keys).distinct(), keys, "left_semi").select(
        "volume", F.col("_at").alias("file_id")
    ).distinct()


def rechain(chain: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Chains of ``nodes``, given those from before the folders in ``changed`` did change.

    Only chains that led past a changed folder, and those of new folders, are walked
    anew; they end in the others, which are complete, so the rounds are as many as the
    depth of the changed part takes.
    """
    keys = ["volume", "file_id"]
    stale = materialize(below(chain, changed).unionByName(changed.select(*keys)).distinct(), "stale")
    kept = chain.join(stale, keys, "left_anti")
    # Parents that were missing may be there now: chains that ended at one are walked anew too.
    redone = _walks(nodes.join(stale, keys, "left_semi"))
    upper = kept.select(
        F.col("volume").alias("v"), F.col("file_id").alias("f"), F.col("visited").alias("more"),
        F.col("looped").alias("rings"),
    )
    joined = redone.join(upper, (F.col("volume") == F.col("v")) & (F.col("next") == F.col("f")), "left")
    ended = joined.select(
        *keys,
        F.when(F.col("more").isNotNull(), F.concat("visited", "more")).otherwise(F.col("visited")).alias("visited"),
        F.when(F.col("more").isNull(), F.col("next")).alias("next"),
        (F.col("looped") | F.coalesce("rings", F.lit(False))).alias("looped"),
    )
    return kept.unionByName(_finished(ended).select(*kept.columns))


def _double(walk: DataFrame) -> DataFrame:
    """Walks still under way, continued by the walk of the node they reached.

    Finished rows keep their own id as join key, so they do not pile up on NULL.
    """
    further = walk.select(
        F.col("volume").alias("v"),
        F.col("file_id").alias("f"),
        F.col("visited").alias("more"),
        F.col("next").alias("then"),
        F.col("looped").alias("rings"),
    )
    on = (
        (F.col("volume") == F.col("v"))
        & (F.coalesce("next", "file_id") == F.col("f"))
        & F.col("next").isNotNull()
    )
    joined = walk.join(further, on, "left")
    # After the first repeated node everything repeats, so the distinct ids are a prefix.
    whole = joined.withColumn("all", F.when(F.col("more").isNotNull(), F.concat("visited", "more")))
    kept = whole.withColumn("kept", F.size(F.array_distinct(F.transform("all", lambda a: a["id"]))))
    again = F.col("all").isNotNull() & (F.col("kept") < F.size("all"))
    return kept.select(
        "volume",
        "file_id",
        F.when(again, F.slice("all", F.lit(1), F.col("kept"))).otherwise(F.coalesce("all", "visited")).alias("visited"),
        F.when(~again, F.col("then")).alias("next"),
        (F.col("looped") | again | (F.coalesce("rings", F.lit(False)) & F.col("then").isNull())).alias("looped"),
    )


def closure(chain: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (file_id, ancestor_id, depth) pairs, parents at depth 1."""
    pairs = chain.select("volume", "file_id", F.posexplode("visited").alias("depth", "a")).filter("depth > 0")
    if max_depth is not None:
        pairs = pairs.filter(F.col("depth") <= max_depth)
    return pairs.select("volume", "file_id", F.col("a.id").alias("ancestor_id"), F.col("depth").cast("long"))


def _path_names(visited: Column) -> Column:
    """Names from the top down, cut at the first empty or volume-named one."""
    ends = F.array_position(
        F.transform(visited, lambda a: (a["name"] == "") | (a["name"] == F.col("volume"))), F.lit(True)
    ).cast("int")
    kept = F.when(ends > 0, F.slice(visited, F.lit(1), ends - 1)).otherwise(visited)
    return F.reverse(F.transform(kept, lambda a: a["name"]))


def directory_paths(chain: DataFrame) -> DataFrame:
    """(volume, file_id, dir_path) of every directory; the root's is empty."""
    return chain.select("volume", "file_id", F.array_join(_path_names(F.col("visited")), "/").alias("dir_path"))


def with_path(facts: DataFrame, chain: DataFrame, column: str = "path") -> DataFrame:
    """Add the full path below the volume, own name included."""
    dirs = directory_paths(chain).select(
        "volume", F.col("file_id").alias("parent_file_id"), F.col("dir_path").alias("_parent")
    )
    own = F.col("name")
    joined = facts.join(dirs, ["volume", "parent_file_id"], "left")
    up = F.when(
        (F.col("parent_file_id") != F.col("file_id")) & (F.coalesce("_parent", F.lit("")) != ""),
        F.concat("_parent", F.lit("/"), own),
    ).otherwise(own)
    path = F.when((own == "") | (own == F.col("volume")), F.lit("")).otherwise(up)
    return joined.select(*facts.columns, path.alias(column))


def subtree(df: DataFrame, chain: DataFrame, volume: str, root_id: int) -> DataFrame:
    """Rows strictly below a folder; ``df`` has volume, file_id, parent_file_id."""
    below = chain.filter(
        (F.col("volume") == volume) & F.exists("visited", lambda a: a["id"] == F.lit(root_id))
    ).select("volume", F.col("file_id").alias("parent_file_id"))
    inside = df.filter((F.col("volume") == volume) & (F.col("file_id") != root_id))
    return inside.join(below, ["volume", "parent_file_id"], "left_semi").select(*df.columns)


def _roll_up(chain: DataFrame, direct: DataFrame, values: list[str]) -> DataFrame:
    """Add the ``values`` of each directory to itself and to all its ancestors.

    ``direct`` is one row per parent, so the fan-out is directories times depth
    and never files times depth.
    """
    held = chain.join(
        direct.withColumnRenamed("parent_file_id", "file_id"), ["volume", "file_id"], "left"
    )
    touched = F.col(values[0]).isNotNull()
    reach = held.select(
        "volume",
        F.explode(F.when(touched, F.col("visited")).otherwise(F.slice("visited", 1, 1))).alias("a"),
        *values,
    )
    return reach.groupBy("volume", F.col("a.id").alias("file_id"), F.col("a.name").alias("name")).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]
    )


def rollup_sizes(facts: DataFrame, chain: DataFrame) -> DataFrame:
    """Per directory: bytes and number of all files beneath, at any depth."""
    direct = (
        facts.filter("not is_directory")
        .groupBy("volume", "parent_file_id")
        .agg(F.sum("size").alias("size"), F.count("*").alias("item_count"))
    )
    return _roll_up(chain, direct, ["size", "item_count"])


def rollup_changes(items: DataFrame, chain: DataFrame) -> DataFrame:
    """Per directory: change, row count and changed items beneath.

    ``items`` is one row per changed item: volume, file_id, parent_file_id,
    size_delta, churn. An item parented to itself counts nowhere.
    """
    direct = (
        items.filter("parent_file_id <> file_id")
        .groupBy("volume", "parent_file_id")
        .agg(
            F.sum("size_delta").alias("size_delta"),
            F.sum("churn").alias("churn"),
            F.count("*").alias("item_count"),
        )
    )
    return _roll_up(chain, direct, ["size_delta", "churn", "item_count"])


# --- path -> id ---------------------------------------------------------------------------


def lookup_paths(
    paths: DataFrame, facts: DataFrame, chain: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """Resolve ``path`` ("C:/a/b") to (volume, file_id, found_in); NULL when unknown.

    The folder part is matched against directory paths, then the last segment
    against the children of that folder, so both joins have near-unique keys.
    With ``log``, paths of deleted items resolve through the log.
    """
    wanted = paths.select("path").distinct().select(
        "path", drive_of(F.col("path")).alias("volume"), F.transform(after_drive(F.col("path")), ascii_lower).alias("parts")
    ).withColumn("leaf", F.try_element_at("parts", F.lit(-1)))
    wanted = wanted.withColumn(
        "folder", F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), "/")
    )
    # Folder paths without the top element, whatever that is named.
    top_at = F.array_position(F.transform("visited", lambda a: a["top"]), F.lit(True)).cast("int")
    folders = chain.filter(top_at > 0).select(
        "volume",
        F.col("file_id").alias("folder_id"),
        F.array_join(
            F.reverse(F.transform(F.slice("visited", F.lit(1), top_at - 1), lambda a: ascii_lower(a["name"]))), "/"
        ).alias("folder"),
    )
    # Inner joins, so that the asked paths may be the side that is broadcast; they come
    # together with those that were not found at the end.
    placed = wanted.join(folders, ["volume", "folder"])
    children = facts.select(
        "volume", F.col("parent_file_id").alias("folder_id"), ascii_lower(F.col("name")).alias("leaf"),
        F.col("file_id").alias("child_id"),
    ).filter("child_id <> folder_id")
    below = placed.filter("leaf is not null").join(children, ["volume", "folder_id", "leaf"])
    hits = below.select("path", F.col("child_id").alias("hit")).unionByName(
        placed.filter("leaf is null").select("path", F.col("folder_id").alias("hit"))
    )
    found = hits.groupBy(F.col("path").alias("_path")).agg(F.min("hit").alias("file_id"))
    live = wanted.join(found, F.col("path") == F.col("_path"), "left")
    live = live.select("path", "volume", "parts", "leaf", "file_id").withColumn("found_in", F.when(F.col("file_id").isNotNull(), F.lit("facts")))
    if log is None:
        return live.select("path", "volume", "file_id", "found_in")
    # Read three times below; what finds the asked paths is worked out once.
    return _lookup_deleted(materialize(live, "live"), facts, log, chain)


def resolve_path(path: str, facts: DataFrame, log: DataFrame | None = None) -> tuple[str, int]:
    """(volume, id) of a single path; LookupError when there is none.

    Goes down from the root by literal predicates, one narrow scan per segment,
    so no chains are needed unless the path has to be found in the log.
    """
    norm = path.replace("\\", "/")
    if norm[1:2] != ":":
        raise LookupError(f"no volume in path: {path}")
    volume, names = norm[:2].upper(), [n for n in norm[2:].split("/") if n]
    here = facts.filter(F.col("volume") == volume)
    top = F.col("parent_file_id") == F.col("file_id")
    named = F.col("name").isin(volume, volume.rstrip(":"))
    row = here.filter(top | named).agg(
        F.coalesce(F.min(F.when(top, F.col("file_id"))), F.min("file_id")).alias("id")
    ).first()
    at = row.id
    for name in names:
        if at is None:
            break
        child = (F.col("parent_file_id") == at) & (F.col("file_id") != at)
        same = ascii_lower(F.col("name")) == ascii_lower(F.lit(name))
        at = here.filter(child & same).agg(F.min("file_id").alias("id")).first().id
    if at is None and log is not None and names:
        asked = facts.sparkSession.createDataFrame([(path,)], "path string")
        row = lookup_paths(asked, here, chains(directories(here)), log.filter(F.col("volume") == volume)).first()
        at = row.file_id
    if at is None:
        raise LookupError(f"path not found: {path}")
    return volume, at


def known_chains(
    wanted: DataFrame, facts: DataFrame, log: DataFrame, chain: DataFrame | None = None
) -> DataFrame:
    """Chains that cover the folders in ``wanted`` (volume, file_id), also deleted ones.

    Folders missing from facts take their latest log row, and so on for the
    parents of those: one look into the log per level of deleted folders, none
    in the usual case. ``chain``, the chains of ``facts``, is used when it already covers
    everything; otherwise only those of deleted folders, and of folders left below them,
    are walked.
    """
    keys = ["volume", "file_id"]
    live = facts.select(*keys)
    gone: DataFrame | None = None
    missing = materialize(wanted.select(*keys).distinct().join(live, keys, "left_anti"), "missing")
    while not missing.isEmpty():
        latest = (
            log.join(missing, keys, "left_semi")
            .groupBy(*keys)
            .agg(F.max_by(F.struct("parent_file_id", "name"), "sequence").alias("r"))
            .select(*keys, "r.parent_file_id", "r.name")
        )
        found = materialize(latest, "deleted")
        gone = found if gone is None else gone.unionByName(found)
        above = found.filter("parent_file_id <> 0").select("volume", F.col("parent_file_id").alias("file_id")).distinct()
        missing = materialize(
            above.join(live, keys, "left_anti").join(gone.select(*keys), keys, "left_anti"), "missing"
        )
    if gone is None:
        return chain if chain is not None else chains(directories(facts))
    nodes = directories(facts).unionByName(gone)
    if chain is None:
        return chains(nodes)
    lost = gone.select("volume", F.col("file_id").alias("parent_file_id"))
    below_lost = directories(facts).join(lost, ["volume", "parent_file_id"], "left_semi").select(*keys)
    return rechain(chain, nodes, gone.select(*keys).unionByName(below_lost))


def _lookup_deleted(live: DataFrame, facts: DataFrame, log: DataFrame, chain: DataFrame) -> DataFrame:
    missing = live.filter("file_id is null and leaf is not null").select("path", "volume", "parts", "leaf")
    candidates = (
        log.withColumn("leaf", ascii_lower(F.col("name")))
        .join(missing.select("volume", "leaf").distinct(), ["volume", "leaf"], "left_semi")
        .groupBy("volume", "leaf", "file_id", F.col("parent_file_id").alias("folder_id"))
        .agg(F.max("sequence").alias("sequence"))
    )
    candidates = materialize(candidates, "candidates")
    folders = candidates.select("volume", F.col("folder_id").alias("file_id"))
    chain = known_chains(folders, facts, log, chain).select("volume", F.col("file_id").alias("folder_id"), "visited")
    # Each candidate under every ending of its path: the name alone when it lies
    # at the top, the name with one folder, with two, and so on. The latest
    # candidate per ending is kept before the join, which is then one to one.
    names = F.transform("visited", lambda a: ascii_lower(a["name"]))
    endings = (
        candidates.join(chain, ["volume", "folder_id"])
        .select(
            "volume", "leaf", "file_id", "sequence", names.alias("names"), F.col("visited")[0]["top"].alias("top"),
            F.explode(F.sequence(F.lit(0), F.size("visited"))).alias("depth"),
        )
        .filter("depth > 0 or top")
        .select(
            "volume", "depth", "file_id", "sequence",
            F.concat(F.reverse(F.slice("names", F.lit(1), F.col("depth"))), F.array("leaf")).alias("parts"),
        )
        .groupBy("volume", "depth", "parts")
        .agg(F.max_by("file_id", "sequence").alias("log_id"))
    )
    found = (
        missing.withColumn("depth", F.size("parts") - 1)
        .join(endings, ["volume", "depth", "parts"])
        .select("path", "log_id")
    )
    out = live.join(found, "path", "left")
    return out.select(
        "path",
        "volume",
        F.coalesce("file_id", "log_id").alias("file_id"),
        F.coalesce("found_in", F.when(F.col("log_id").isNotNull(), F.lit("log"))).alias("found_in"),
    )


# --- display trees -------------------------------------------------------------------------


def tree_scores(hits: DataFrame) -> DataFrame:
    """Every node of the tree spanned by ``hits`` with the best score below it.

    ``hits``: volume, path (parent folder), name, score. Result: volume, node
    (path; empty for the volume), score, is_match.
    """
    spans = hits.select(
        "volume",
        "score",
        F.concat(
            F.array(F.lit("")), prefixes(F.concat(segments(F.col("path")), F.array("name")))
        ).alias("nodes"),
    )
    each = spans.select("volume", "score", F.posexplode("nodes").alias("i", "node"), F.size("nodes").alias("n"))
    return each.groupBy("volume", "node").agg(
        F.max("score").alias("score"), F.max(F.col("i") == F.col("n") - 1).alias("is_match")
    )


def as_tree(hits: DataFrame, by_score: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """Display rows of the result tree in ``sort_path`` order.

    Siblings go by score (best first) then name, or by name alone. The last
    sibling is found by an aggregate per parent and the order by an array of
    sibling keys, so a folder with very many hits needs no window. ``texts``
    (volume, node, text) replaces the label of some nodes.
    """
    parts = F.split("node", "/")
    rank = (-F.col("score") if by_score else F.lit(0.0)).cast("double")
    nodes = tree_scores(hits).select(
        "volume",
        "node",
        "score",
        "is_match",
        F.when(F.col("node") == "", F.lit(0)).otherwise(F.size(parts)).cast("long").alias("depth"),
        F.when(F.col("node") == "", F.col("volume")).otherwise(F.element_at(parts, -1)).alias("label"),
        F.when(
            F.col("node") != "", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
        ).alias("parent"),
    ).withColumn("key", F.struct(rank.alias("rank"), "label"))
    ends = nodes.filter("parent is not null").groupBy("volume", "parent").agg(F.max("key").alias("end"))
    siblings = nodes.join(ends, ["volume", "parent"], "left").withColumn(
        "is_last", F.coalesce(F.col("key") == F.col("end"), F.lit(True))
    )
    # Every node looks up the keys of the nodes on its own path: depth rows each.
    on_path = F.when(F.col("node") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), prefixes(parts))
    )
    ups = siblings.select("volume", "node", F.explode(on_path).alias("up"))
    marks = siblings.select("volume", F.col("node").alias("up"), "depth", "key", "is_last")
    ways = (
        ups.join(marks, ["volume", "up"])
        .groupBy("volume", "node")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "key", "is_last"))).alias("way"))
    )
    out = siblings.join(ways, ["volume", "node"])
    plain = F.when(F.col("is_match"), F.col("label")).otherwise(F.concat("label", F.lit("/")))
    text = plain
    if texts is not None:
        out = out.join(texts.select("volume", "node", "text"), ["volume", "node"], "left")
        text = F.coalesce("text", plain)
    between = F.slice("way", F.lit(2), F.greatest(F.size("way") - 2, F.lit(0)))
    guide = F.array_join(F.transform(between, lambda s: F.when(s["is_last"], F.lit("    ")).otherwise(F.lit("│   "))), "")
    branch = F.when(F.col("is_last"), F.lit("└── ")).otherwise(F.lit("├── "))
    line = F.when(F.col("depth") == 0, F.concat("label", F.lit("\\"))).otherwise(F.concat(guide, branch, text))
    return out.select(
        "volume", "node", "parent", "depth", "score", "is_match", "is_last", line.alias("line"),
        F.transform("way", lambda s: s["key"]).alias("sort_path"),
    )


def diff_tree(changes: DataFrame) -> DataFrame:
    """Display rows of a difference (volume, path, kind, size_delta, old_name, file_id), by name.

    Of several changes at one path the one with the highest id is shown.
    """
    node = F.array_join(F.slice(segments(F.col("path")), F.lit(2), F.size(segments(F.col("path")))), "/")
    placed = changes.select("volume", node.alias("node"), "name", "kind", "size_delta", "old_name", "file_id")
    size = human_delta(F.col("size_delta"))
    sign = F.when(F.col("kind") == CREATED, F.lit("+ ")).when(F.col("kind") == DELETED, F.lit("- ")).otherwise(F.lit("~ "))
    note = F.when(
        F.col("kind") == RENAMED, F.concat(F.lit("Renamed from "), F.coalesce("old_name", F.lit("unknown")), F.lit(", "))
    ).otherwise(F.lit(""))
    text = F.concat(sign, F.col("name"), F.lit(" ("), note, size, F.lit(")"))
    texts = placed.groupBy("volume", "node").agg(F.max_by(text, "file_id").alias("text"))
    folder = F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", "")).otherwise(F.lit(""))
    hits = placed.select("volume", folder.alias("path"), "name", F.lit(0.0).alias("score"))
    return as_tree(hits, by_score=False, texts=texts)
