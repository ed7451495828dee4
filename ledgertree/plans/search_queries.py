"""Name search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertree.operators import search, token_index, tree
from ledgertree.plans import shared as S
from ledgertree.plans.fixtures import Fixtures
from ledgertree.plans.registry import part, query

part("docs", "", """
 select p.volume || '-' || cast(p.file_id as varchar) as uid, p.volume, p.file_id, p.name, lower(p.name) as name_lower,
        coalesce(d.dir_path, '') as path, lower(regexp_extract(p.name, '^.+\\.([^.]*)$', 1)) as ext, p.size,
        cast(floor(epoch(p.modified_at)) as bigint) as modified_at, p.is_directory, p.attributes
 from fx_facts p left join (select volume as v, file_id as parent, dir_path from dirpath) d
   on d.v = p.volume and d.parent = p.parent_file_id""")

_BITS = [(1, "readonly", "R"), (2, "hidden", "H"), (4, "system", "S"), (32, "archive", "A"), (1024, "reparse", "L")]
_NAMES = " || ".join(f"case when attributes & {b} <> 0 then '{n},' else '' end" for b, n, _ in _BITS)
_FLAGS = " || ".join(f"case when attributes & {b} <> 0 then '{f}' else '' end" for b, _, f in _BITS)


@query("search_documents", f"""
select uid, volume, file_id, name, path, ext, size, modified_at, is_directory, rtrim({_NAMES}, ',') as attributes,
       case when {_FLAGS} = '' then '-' else {_FLAGS} end as flags from docs""")
def search_documents(fx: Fixtures):
    docs = search.build_documents(S.facts(fx), S.chain(fx))
    return docs.select(
        "uid", "volume", "file_id", "name", "path", "ext", "size", "modified_at", "is_directory",
        F.array_join("attributes", ",").alias("attributes"), "flags",
    )


_HIT = ["uid", "name", "score"]

# Named parts, their tokens and padded tokens.
part("words", "", """
 select 'P:-' || cast(file_id as varchar) as uid, name, lower(name) as name_lower,
        [t for t in regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+') if t <> ''] as tokens
 from fx_names""")


def _padded() -> str:
    return "' ' || array_to_string(tokens, ' ') || ' '"


def _tiers(text: str) -> dict[str, str]:
    """The kinds of match in SQL, for a query of plain words."""
    words = text.lower().split()
    joined = "".join(words)
    grams = sorted({joined[i : i + n] for n in range(3, 11) for i in range(len(joined) - n + 1)})

    def every(test: str) -> str:
        return " and ".join(f"len([t for t in tokens if {test.format(w=w)}]) > 0" for w in words)

    fuzzy = [w for w in words if len(w) > 2]
    near = " and ".join(
        f"len([t for t in tokens if damerau_levenshtein(t, '{w}') <= {2 if len(w) > 5 else 1}]) > 0" for w in fuzzy
    )
    return {
        "phrase": f"case when contains({_padded()}, ' {' '.join(words)} ') then {16.0 if len(words) > 1 else 10.0} else 0 end",
        "terms": f"case when {every(chr(116) + ' = ' + chr(39) + '{w}' + chr(39))} then 3.0 else 0 end",
        "prefix": f"case when {every('starts_with(t, ' + chr(39) + '{w}' + chr(39) + ')')} then {1.5 * len(words)} else 0 end",
        "gram": "1.2 * (" + " + ".join(f"case when contains(name_lower, '{g}') then 1 else 0 end" for g in grams) + ")"
        if grams else "0",
        "infix": f"case when {every('contains(t, ' + chr(39) + '{w}' + chr(39) + ')')} then {1.1 * len(words)} else 0 end"
        if all(len(w) > 1 for w in words) else "0",
        "fuzzy": f"case when {near} then {0.8 * len(fuzzy)} else 0 end" if fuzzy else "0",
    }


def _tier_check(text: str, tier: str) -> str:
    value = _tiers(text)[tier]
    return f"select uid, name, round(cast({value} as double), 4) as score from words where {value} > 0"


def _tier(fx: Fixtures, text: str, tier: str):
    hits = token_index.weighted(S.names(fx), S.token_index_of(fx), text, (tier,))
    return hits.withColumn("score", F.round(f"_{tier}", 4)).filter("score > 0").select(*_HIT)


@query("search_substring", "select uid, name, 1.0::double as score from docs where contains(name_lower, 'r_12')")
def search_substring(fx: Fixtures):
    grams = fx.stored("grams", lambda: search.gram_table(S.documents(fx)), ("bucket", "gram", "volume", "file_id"))
    return search.search(S.documents(fx), " R_12", limit=None, grams=grams).select(*_HIT)


@query("search_match_all", "select uid, name, 1.0::double as score from docs")
def search_match_all(fx: Fixtures):
    return search.search(S.documents(fx), "*", limit=None).select(*_HIT)


@query("search_phrase", _tier_check("red widget", "phrase"))
def search_phrase(fx: Fixtures):
    return _tier(fx, "Red Widget", "phrase")


@query("search_all_terms", _tier_check("economy red", "terms"))
def search_all_terms(fx: Fixtures):
    return _tier(fx, "economy red", "terms")


@query("search_prefix", _tier_check("wid eco", "prefix"))
def search_prefix(fx: Fixtures):
    return _tier(fx, "wid eco", "prefix")


@query("search_ngram", _tier_check("idge bolt", "gram"))
def search_ngram(fx: Fixtures):
    return _tier(fx, "idge bolt", "gram")


@query("search_infix", _tier_check("ng con", "infix"))
def search_infix(fx: Fixtures):
    return _tier(fx, "ng con", "infix")


# A word where the two engines' distances agree: no edit between swapped letters.
@query("search_fuzzy", _tier_check("wigdet smal", "fuzzy"))
def search_fuzzy(fx: Fixtures):
    return _tier(fx, "wigdet smal", "fuzzy")


def _score_check(text: str) -> str:
    total = " + ".join(_tiers(text).values())
    return f"select uid, name, round(cast({total} as double), 4) as score from words where {total} > 0"


@query("search_tier_score", _score_check("small gizmo"))
def search_tier_score(fx: Fixtures):
    return search.search(S.names(fx), "small gizmo", advanced=True, limit=None, index=S.token_index_of(fx)).select(*_HIT)


def _bm25_check(text: str) -> str:
    words = sorted(set(text.split()))
    tiers = _tiers(text)
    other = " + ".join(tiers[k] for k in ("prefix", "gram", "infix", "fuzzy"))
    counts = ", ".join(f"count(*) filter (where list_contains(tokens, '{w}')) as df{i}" for i, w in enumerate(words))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * 2.2 * len([t for t in tokens if t = '{w}'])"
        f" / (len([t for t in tokens if t = '{w}']) + 1.2 * (0.25 + 0.75 * len(tokens) / mean))"
        for i, w in enumerate(words)
    )
    return f"""
select uid, name, round(cast({other} + ({tiers['phrase']} + {tiers['terms']}) * ({score}) as double), 3) as score
from words cross join (select cast(count(*) as double) as n, avg(len(tokens)) as mean, {counts} from words)
where {' + '.join(tiers.values())} > 0"""


@query("search_bm25", _bm25_check("red widget"))
def search_bm25(fx: Fixtures):
    stats = tuple(fx.keep(f"term-stats-{i}", lambda i=i: search.term_stats(S.names(fx))[i]) for i in (0, 1))
    hits = search.search(S.names(fx), "red widget", advanced=True, bm25=True, limit=None, stats=stats, index=S.token_index_of(fx))
    return hits.select("uid", "name", F.round("score", 3).alias("score"))


@query("search_filter_path", "select uid, name, path from docs where starts_with(path, 'NATION_1/Customer')")
def search_filter_path(fx: Fixtures):
    return search.search(S.documents(fx), path="\\NATION_1\\Customer", limit=None).select("uid", "name", "path")


@query("search_filter_ext_volume", "select uid, name, ext, volume from docs where ext = 'pdf' and volume = 'D:'")
def search_filter_ext_volume(fx: Fixtures):
    return search.search(S.documents(fx), ext=".PDF", volume="D:", limit=None).select("uid", "name", "ext", "volume")


@query("search_filter_ranges", """
select uid, size, modified_at from docs where size >= 100000 and size <= 200000
  and modified_at >= 820454400 and modified_at <= 852076800""")
def search_filter_ranges(fx: Fixtures):
    found = search.search(
        S.documents(fx), min_size=100_000, max_size=200_000, modified_after=820_454_400, modified_before=852_076_800,
        limit=None,
    )
    return found.select("uid", "size", "modified_at")


@query("search_filter_attributes", "select uid, name from docs where attributes & 2 <> 0 and attributes & 4 = 0")
def search_filter_attributes(fx: Fixtures):
    return search.search(S.documents(fx), hidden=True, system=False, limit=None).select("uid", "name")


@query("search_topk", f"select * from ({_score_check('hot gear')}) order by score desc, name, uid limit 100")
def search_topk(fx: Fixtures):
    return search.search(S.names(fx), "hot gear", advanced=True, index=S.token_index_of(fx)).select(*_HIT)


@query("search_reconcile", """
select d.uid, d.name, 1.0::double as score from docs d semi join replayed r on r.volume = d.volume and r.file_id = d.file_id
where contains(d.name_lower, 'order')""")
def search_reconcile(fx: Fixtures):
    hits = search.search(S.documents(fx), "order", limit=None)
    return search.reconcile(hits, S.replayed(fx)).select(*_HIT)


# --- trees of results --------------------------------------------------------------------

# Order files matching "12", scored by the share of 12s; each with the nodes above it.
part("tree_hits", "", """
 select volume, path, name, cast(len(string_split(name, '12')) - 1 as double) as score from docs
 where contains(name_lower, '12')""")
part("tree_spans", "", """
 select volume, score, [x for x in string_split(path, '/') if x <> ''] || [name] as parts from tree_hits""")
part("tree_nodes", "", """
 select volume, array_to_string(parts[1:i], '/') as node, max(score) as score, bool_or(i = len(parts)) as is_match,
        max(i) as depth, case when max(i) > 0 then array_to_string(any_value(parts)[1:max(i) - 1], '/') end as parent,
        case when max(i) = 0 then volume else any_value(parts)[max(i)] end as label
 from (select *, unnest(range(0, len(parts) + 1)) as i from tree_spans) group by volume, array_to_string(parts[1:i], '/')""")
part("tree_last", "", """
 select *, node = '' or row_number() over (partition by volume, parent order by score, label desc) = 1 as is_last
 from tree_nodes""")
part("tree_lines", "(volume, node, label, depth, is_match, is_last, score, guide)", """
 select volume, node, label, depth, is_match, is_last, score, '' from tree_last where depth <= 1
 union all
 select c.volume, c.node, c.label, c.depth, c.is_match, c.is_last, c.score,
        p.guide || case when p.is_last then '    ' else '│   ' end
 from tree_lines p join tree_last c on c.volume = p.volume and c.parent = p.node and c.depth = p.depth + 1
 where p.depth >= 1""")


def _hits(fx: Fixtures):
    found = search.search(S.documents(fx), "12", limit=None)
    score = (F.size(F.split("name", "12")) - 1).cast("double")
    return found.withColumn("score", score)


@query("tree_max_score", "select volume, node, score, is_match from tree_nodes")
def tree_max_score(fx: Fixtures):
    return tree.tree_scores(_hits(fx))


@query("result_tree", """
select volume, node, cast(depth as bigint) as depth, is_match, is_last, score,
       case when depth = 0 then label || chr(92) else guide || case when is_last then '└── ' else '├── ' end
         || label || case when is_match then '' else '/' end end as line
from tree_lines""")
def result_tree(fx: Fixtures):
    return tree.as_tree(_hits(fx)).select("volume", "node", "depth", "is_match", "is_last", "score", "line")
