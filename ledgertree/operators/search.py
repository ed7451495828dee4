"""Name search over documents built from facts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.functions import text as X
from ledgertree.operators import token_index, tree
from ledgertree.session import spread

DEFAULT_LIMIT = 100

# Weight of each kind of match.
PHRASE, PHRASE_WORDS, ALL_TERMS, PREFIX, GRAM, INFIX, FUZZY = 10.0, 6.0, 3.0, 1.5, 1.2, 1.1, 0.8
# Bytes a word needs to be matched fuzzily, and to be allowed two edits.
FUZZY_FROM, TWO_EDITS_FROM = 3, 6
# Saturation and length weight of the term score.
K1, LENGTH_WEIGHT = 1.2, 0.75


def build_documents(facts: DataFrame, chain: DataFrame) -> DataFrame:
    """Facts as search documents."""
    dirs = tree.directory_paths(chain).select(
        "volume", F.col("file_id").alias("parent_file_id"), F.col("dir_path").alias("path")
    )
    joined = facts.join(dirs, ["volume", "parent_file_id"], "left")
    return joined.select(
        F.concat_ws("-", "volume", "file_id").alias("uid"),
        "volume",
        "file_id",
        "name",
        F.lower("name").alias("name_lower"),
        F.coalesce("path", F.lit("")).alias("path"),
        X.extension(F.col("name")).alias("ext"),
        "size",
        F.unix_timestamp("modified_at").alias("modified_at"),
        "is_directory",
        X.attribute_names(F.col("attributes")).alias("attributes"),
        X.attribute_flags(F.col("attributes")).alias("flags"),
        X.tokens(F.col("name")).alias("tokens"),
    )


def sync_documents(docs: DataFrame, facts: DataFrame, changed: DataFrame, chain: DataFrame) -> DataFrame:
    """Documents after a replay: those of ``changed`` (volume, file_id) are rebuilt from facts."""
    keys = ["volume", "file_id"]
    touched = changed.select(*keys).distinct()
    kept = docs.join(touched, keys, "left_anti")
    fresh = build_documents(facts.join(touched, keys, "left_semi"), chain)
    return kept.select(*fresh.columns).unionByName(fresh)


# --- matching ------------------------------------------------------------------------------


def _words(query: str) -> list[str]:
    return query.strip().lower().split()


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _any_token(test) -> Column:
    return F.exists("tokens", test)


def substring_match(query: str) -> Column:
    return F.col("name_lower").contains(query.strip().lower())


def phrase_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", query.strip().lower()) if t]


def phrase_match(query: str) -> Column:
    """The query's tokens stand next to each other in the name."""
    wanted = phrase_tokens(query)
    if not wanted:
        return F.lit(False)
    padded = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    return padded.contains(" " + " ".join(wanted) + " ")


def all_terms_match(query: str) -> Column:
    return _all([F.array_contains("tokens", w) for w in _words(query)])


def prefix_match(query: str) -> Column:
    def starts(word: str) -> Column:
        return _any_token(lambda t: t.startswith(word))

    return _all([starts(w) for w in _words(query)])


def query_grams(query: str) -> list[str]:
    return X.grams("".join(_words(query)))


def gram_count(query: str) -> Column:
    """How many of the query's distinct 3- to 10-grams the name contains."""
    wanted = query_grams(query)
    if not wanted:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("name_lower"), g)))


def infix_match(query: str) -> Column:
    words = _words(query)
    if any(len(w.encode()) < 2 for w in words):
        return F.lit(False)

    def holds(word: str) -> Column:
        return _any_token(lambda t: F.contains(t, F.lit(word)))

    return _all([holds(w) for w in words])


def fuzzy_words(query: str) -> list[str]:
    return [w for w in _words(query) if len(w.encode()) >= FUZZY_FROM]


def fuzzy_match(query: str) -> Column:
    """Every longer word is one edit (up to 5 bytes) or two from some token."""
    words = fuzzy_words(query)
    if not words:
        return F.lit(False)

    def near(word: str) -> Column:
        limit = 2 if len(word.encode()) >= TWO_EDITS_FROM else 1
        return _any_token(lambda t: X.within_edits(t, word, limit))

    return _all([near(w) for w in words])


def tier_weights(query: str) -> dict[str, Column]:
    """Weight each kind of match adds to a document's score; 0 where it misses."""
    words = _words(query)
    zero = F.lit(0.0)

    def worth(hit: Column, weight: float) -> Column:
        return F.when(hit, F.lit(weight)).otherwise(zero)

    phrase = phrase_match(query)
    return {
        "phrase": worth(phrase, PHRASE + (PHRASE_WORDS if len(words) > 1 else 0.0)),
        "terms": worth(all_terms_match(query), ALL_TERMS),
        "prefix": worth(prefix_match(query), PREFIX * len(words)),
        "gram": F.lit(GRAM) * gram_count(query),
        "infix": worth(infix_match(query), INFIX * len(words)),
        "fuzzy": worth(fuzzy_match(query), FUZZY * len(fuzzy_words(query))),
    }


def term_stats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What term scores need of the corpus: (n, length) in one row, and (token, df).

    Tables to keep beside the documents; :func:`merge_term_stats` adds those of new
    documents, or takes off those of removed ones with ``sign=-1``.
    """
    totals = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("length"))
    each = docs.select(F.explode(F.array_distinct("tokens")).alias("token"))
    return totals, each.groupBy("token").agg(F.count("*").alias("df"))


def merge_term_stats(
    stats: tuple[DataFrame, DataFrame], more: tuple[DataFrame, DataFrame], sign: int = 1
) -> tuple[DataFrame, DataFrame]:
    totals = stats[0].unionByName(more[0].select((sign * F.col("n")).alias("n"), (sign * F.col("length")).alias("length")))
    terms = stats[1].unionByName(more[1].select("token", (sign * F.col("df")).alias("df")))
    return (
        totals.agg(F.sum("n").alias("n"), F.sum("length").alias("length")),
        terms.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0"),
    )


def bm25_weights(docs: DataFrame, query: str, stats: tuple[DataFrame, DataFrame] | None = None) -> Column:
    """Σ over the query words of the term score in each document.

    The corpus figures are one row and one row per query word, read from ``stats``
    where it is kept; otherwise they take a pass over the documents.
    """
    words = sorted(set(_words(query)))
    totals, terms = term_stats(docs) if stats is None else stats
    ends = totals.first()
    found = {r["token"]: r["df"] for r in terms.filter(F.col("token").isin(words)).collect()}
    stats = {"n": ends["n"], "mean": ends["length"] / ends["n"] if ends["n"] else None}
    stats |= {f"df{i}": found.get(w, 0) for i, w in enumerate(words)}
    length = LENGTH_WEIGHT * F.size("tokens") / F.lit(float(stats["mean"] or 1.0))
    score = F.lit(0.0)

    def frequency(word: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == word)).cast("double")

    for i, word in enumerate(words):
        df = stats[f"df{i}"]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        tf = frequency(word)
        score = score + F.lit(idf * (K1 + 1)) * tf / (tf + K1 * (1 - LENGTH_WEIGHT + length))
    return score


def search(
    docs: DataFrame,
    query: str = "*",
    *,
    advanced: bool = False,
    bm25: bool = False,
    path: str | None = None,
    ext: str | None = None,
    volume: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    modified_after: int | None = None,
    modified_before: int | None = None,
    hidden: bool | None = None,
    system: bool | None = None,
    limit: int | None = DEFAULT_LIMIT,
    grams: DataFrame | None = None,
    stats: tuple[DataFrame, DataFrame] | None = None,
    index: token_index.TokenIndex | None = None,
) -> DataFrame:
    """Documents matching the text and all filters, best score first.

    With ``grams``, see :func:`gram_table`, a substring search reads the names that
    hold all grams of the text instead of all names. ``stats``, see
    :func:`term_stats`, spares ``bm25`` its pass over the documents. With ``index``, see
    ``token_index.build``, an advanced search finds the names through tables of tokens
    and reads only those; without it, it is a row-wise expression over one scan.
    ``limit=None`` returns every hit, unordered.
    """
    hits = docs
    if volume is not None:
        hits = hits.filter(F.col("volume") == volume)
    if ext is not None:
        hits = hits.filter(F.col("ext") == ext.lstrip(".").lower())
    if path is not None:
        hits = hits.filter(F.col("path").startswith(path.replace("\\", "/").lstrip("/")))
    if min_size is not None:
        hits = hits.filter(F.col("size") >= min_size)
    if max_size is not None:
        hits = hits.filter(F.col("size") <= max_size)
    if modified_after is not None:
        hits = hits.filter(F.col("modified_at") >= modified_after)
    if modified_before is not None:
        hits = hits.filter(F.col("modified_at") <= modified_before)
    for wanted, name in ((hidden, "hidden"), (system, "system")):
        if wanted is not None:
            has = F.array_contains("attributes", name)
            hits = hits.filter(has if wanted else ~has)

    if not _words(query) or query == "*":
        hits = hits.withColumn("score", F.lit(1.0))
    elif not advanced:
        if grams is not None:
            hits = holding_grams(hits, grams, query)
        hits = hits.filter(substring_match(query)).withColumn("score", F.lit(1.0))
    else:
        tiers = tier_weights(query)
        if index is not None:
            hits = token_index.weighted(hits, index, query)
            tiers = {name: F.col(f"_{name}") for name in tiers}
        matched = sum(tiers.values(), F.lit(0.0))
        score = matched
        if bm25:
            # Phrase and term weights scale with the term score instead of 1.
            by_term = tiers["phrase"] + tiers["terms"]
            score = matched - by_term + by_term * bm25_weights(docs, query, stats)
        hits = hits.withColumn("_matched", matched).filter("_matched > 0")
        hits = hits.withColumn("score", F.round(score, 4)).select(*docs.columns, "score")
    if limit is None:
        return hits
    return hits.orderBy(F.desc("score"), "name", "uid").limit(limit)


# Folders the gram table is split into on disk.
GRAM_BUCKETS = 256


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS))


def gram_table(docs: DataFrame) -> DataFrame:
    """Every distinct 3-gram of every name: bucket, gram, volume, file_id.

    Save it partitioned by bucket and sorted by gram; a search then reads a few
    row groups instead of all names.
    """
    name = F.col("name_lower")
    spots = F.sequence(F.lit(1), F.length(name) - 2)
    grams = F.array_distinct(F.transform(spots, lambda i: F.substr(name, i, F.lit(3))))
    long = spread(docs.filter(F.length(name) >= 3).select("volume", "file_id", "name_lower"), "volume", "file_id")
    rows = long.select(F.explode(grams).alias("gram"), "volume", "file_id")
    return rows.select(_gram_bucket(F.col("gram")).alias("bucket"), "gram", "volume", "file_id")


def save_gram_table(docs: DataFrame, path: str) -> None:
    """A common gram spreads over many files: the ids are part of the range too."""
    order = ["bucket", "gram", "volume", "file_id"]
    rows = gram_table(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def holding_grams(docs: DataFrame, grams: DataFrame, query: str) -> DataFrame:
    """Documents whose names hold every 3-gram of the text; all of them for a shorter text."""
    wanted = X.grams(query.strip().lower(), 3, 3)
    if not wanted:
        return docs
    one_row = docs.sparkSession.range(1).select(*[_gram_bucket(F.lit(g)) for g in wanted])
    buckets = sorted(set(one_row.first()))
    having = (
        grams.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        .groupBy("volume", "file_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == len(wanted))
    )
    return docs.join(having, ["volume", "file_id"], "left_semi")


def search_grams(docs: DataFrame, grams: DataFrame, query: str) -> DataFrame:
    """Every document of a substring search, found through the gram table.

    A name that holds the text holds all its 3-grams; those names are then
    compared in full. Texts under three characters scan the names.
    """
    return search(docs, query, limit=None, grams=grams)


def reconcile(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Drop hits whose file is gone from facts; hits without a key stay."""
    keyless = F.col("volume").isNull() | F.col("file_id").isNull()
    alive = hits.filter(~keyless).join(facts.select("volume", "file_id"), ["volume", "file_id"], "left_semi")
    return alive.unionByName(hits.filter(keyless))
