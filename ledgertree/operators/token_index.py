"""Tables of tokens, so that the advanced tiers of a search read names by key only.

* ``tokens``: the distinct tokens of all names, in order, so a prefix is a range.
* ``postings``: for each token the names that hold it, with its positions there and the
  number of tokens of the name; a phrase is a join of neighbouring positions.
* ``grams``: the distinct pairs and triples of characters of each token: a token that
  contains a word holds all of the word's.
* ``deletions``: each token with every string that one or two deletions leave of it. Two
  words within two edits of each other, swaps included, leave a common string, so a query
  word's own deletions find all tokens near it by equality; only these are compared.
  Tokens above ``LONG`` characters, whose deletions would be many, are kept apart and are
  compared with query words of about their length alone.
* ``name_grams``: the triples of whole names, see ``search.gram_table``.

Tokens are far fewer than names, and each of their tables is a few dozen rows for one
token. What a query finds there meets the postings by token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgertree.functions import text as X
from ledgertree.operators import search as S
from ledgertree.session import materialize, spread

#: Longest token that has rows in ``deletions``.
LONG = 32
BUCKETS = 256

#: Sort orders in which the tables are best stored; ``bucket`` may be a folder.
LAYOUT = {
    "tokens": ("token",),
    "postings": ("token", "volume", "file_id"),
    "grams": ("bucket", "gram", "token"),
    "deletions": ("bucket", "left", "token"),
    "name_grams": ("bucket", "gram", "volume", "file_id"),
}

TIERS = ("phrase", "terms", "prefix", "gram", "infix", "fuzzy")
_KEYS = ["volume", "file_id"]


@dataclass
class TokenIndex:
    tokens: DataFrame
    postings: DataFrame
    grams: DataFrame
    deletions: DataFrame
    name_grams: DataFrame


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS))


def postings_of(docs: DataFrame) -> DataFrame:
    named = spread(docs.filter(F.size("tokens") > 0).select(*_KEYS, "tokens"), *_KEYS)
    rows = named.select(*_KEYS, "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    spots = F.sequence(F.lit(0), F.size("tokens") - 1)
    here = F.filter(spots, lambda i: F.get("tokens", i) == F.col("token"))
    return rows.select("token", *_KEYS, here.alias("positions"), F.size("tokens").alias("length"))


def tokens_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def grams_of(tokens: DataFrame) -> DataFrame:
    size = F.length("token")

    def cut(n: int) -> Column:
        spots = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))))
        return F.coalesce(F.transform(spots, lambda i: F.substr("token", i, F.lit(n))), F.array().cast("array<string>"))

    rows = spread(tokens.select("token"), "token").select("token", F.explode(F.array_distinct(F.concat(cut(2), cut(3)))).alias("gram"))
    return rows.select(_bucket(F.col("gram")).alias("bucket"), "gram", "token")


def _without_one(text: Column) -> Column:
    """The text with each one of its characters left out."""
    spots = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))))
    cut = F.transform(spots, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    return F.coalesce(cut, F.array().cast("array<string>"))


def deletions_of(tokens: DataFrame) -> DataFrame:
    own = F.col("token")
    short = spread(tokens.select("token").filter(F.length(own) <= LONG), "token")
    rows = short.select("token", F.array_distinct(_without_one(own)).alias("one"))
    twice = F.flatten(F.transform("one", _without_one))
    rows = rows.select("token", F.explode(F.array_distinct(F.concat(F.array("token"), "one", twice))).alias("left"))
    return rows.select(_bucket(F.col("left")).alias("bucket"), "left", "token")


def build(docs: DataFrame) -> TokenIndex:
    """All tables; store each in the order of ``LAYOUT``."""
    postings = postings_of(docs)
    tokens = tokens_of(postings)
    return TokenIndex(tokens, postings, grams_of(tokens), deletions_of(tokens), S.gram_table(docs))


def refreshed(index: TokenIndex, changed: DataFrame, fresh: DataFrame) -> TokenIndex:
    """The tables after documents changed: ``changed`` are the keys of all that did, ``fresh``
    those of them that are still there.

    Token tables only grow, by the new tokens' rows; a token no name holds any more finds nothing.
    """
    gone = changed.select(*_KEYS).distinct()
    added = postings_of(fresh)
    new = tokens_of(added).join(index.tokens.select("token"), "token", "left_anti")
    postings = index.postings.join(gone, _KEYS, "left_anti").unionByName(added)
    return TokenIndex(
        tokens_of(postings),
        postings,
        index.grams.unionByName(grams_of(new)),
        index.deletions.unionByName(deletions_of(new)),
        index.name_grams.join(gone, _KEYS, "left_anti").unionByName(S.gram_table(fresh)),
    )


# --- tokens that a query's words stand for --------------------------------------------------


def starting_with(index: TokenIndex, word: str) -> DataFrame:
    return index.tokens.filter(F.col("token").startswith(word)).select("token")


def _in_buckets(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    one = df.sparkSession.range(1).select(*[_bucket(F.lit(v)) for v in values])
    return df.filter(F.col("bucket").isin(sorted(set(one.first()))) & F.col(column).isin(values))


def containing(index: TokenIndex, word: str) -> DataFrame:
    """By the word's triples, or its pair; a single character looks at all tokens."""
    wanted = X.grams(word, min(3, len(word)), min(3, len(word)))
    if len(word) < 2:
        return index.tokens.filter(F.contains("token", F.lit(word))).select("token")
    found = _in_buckets(index.grams, "gram", wanted).groupBy("token").agg(F.count("*").alias("n"))
    return found.filter((F.col("n") == len(wanted)) & F.contains("token", F.lit(word))).select("token")


def deletions(word: str, limit: int) -> list[str]:
    """The word and all that up to ``limit`` deletions leave of it."""
    out = level = {word}
    for _ in range(limit):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return sorted(out)


def near(index: TokenIndex, word: str) -> DataFrame:
    """Tokens that the fuzzy tier takes for ``word``."""
    limit = 2 if len(word.encode()) >= S.TWO_EDITS_FROM else 1
    close = X.within_edits(F.col("token"), word, limit)
    parts = []
    if len(word) <= LONG + limit:
        parts.append(_in_buckets(index.deletions, "left", deletions(word, limit)).select("token").distinct())
    if len(word) > LONG - limit:
        size = F.length("token")
        parts.append(index.tokens.filter((size > LONG) & (F.abs(size - len(word)) <= limit)).select("token"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.filter(close)


def _standing_for(index: TokenIndex, query: str, tiers: tuple[str, ...]) -> DataFrame | None:
    """(tier, word, token): which tokens each word of the query matches in which tier."""
    words, out = S._words(query), []

    def add(tier: str, k: int, tokens: DataFrame) -> None:
        out.append(tokens.select(F.lit(tier).alias("tier"), F.lit(k).alias("word"), "token"))

    spark = index.tokens.sparkSession
    if "terms" in tiers:
        for k, word in enumerate(words):
            add("terms", k, spark.range(1).select(F.lit(word).alias("token")))
    if "prefix" in tiers:
        for k, word in enumerate(words):
            add("prefix", k, starting_with(index, word))
    if "infix" in tiers and all(len(w.encode()) > 1 for w in words):
        for k, word in enumerate(words):
            add("infix", k, containing(index, word))
    if "fuzzy" in tiers:
        for k, word in enumerate(S.fuzzy_words(query)):
            add("fuzzy", k, near(index, word))
    if not out:
        return None
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    # Written, so that the join with the postings is planned by its real size.
    return materialize(whole, "tokens")


def phrases(index: TokenIndex, query: str) -> DataFrame | None:
    """Names in which the query's tokens stand next to each other."""
    wanted = S.phrase_tokens(query)
    if not wanted:
        return None
    places: dict[str, list[int]] = {}
    for k, token in enumerate(wanted):
        places.setdefault(token, []).append(k)
    at = F.create_map(*[x for t, ks in places.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    rows = index.postings.filter(F.col("token").isin(list(places)))
    rows = rows.select(*_KEYS, "positions", F.explode(at[F.col("token")]).alias("k"))
    rows = rows.select(*_KEYS, "k", F.explode("positions").alias("position"))
    starts = rows.groupBy(*_KEYS, (F.col("position") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    return starts.filter(F.col("n") == len(wanted)).select(*_KEYS).distinct()


# --- scores -----------------------------------------------------------------------------------


def weighted(docs: DataFrame, index: TokenIndex, query: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """``docs`` that match in one of ``tiers``, with ``_<tier>``: what each adds to the score.

    The same weights as ``search.tier_weights`` gives, found through the tables; of ``docs``
    only the rows of matching names are read, by key.
    """
    words = S._words(query)
    needed = {"terms": len(words), "prefix": len(words), "infix": len(words), "fuzzy": len(S.fuzzy_words(query))}
    marks: list[DataFrame] = []
    standing = _standing_for(index, query, tiers)
    if standing is not None:
        met = index.postings.select("token", *_KEYS).join(standing, "token")
        counts = [
            (F.count_distinct(F.when(F.col("tier") == t, F.col("word"))) == n).alias(t) for t, n in needed.items() if t in tiers and n
        ]
        marks.append(met.groupBy(*_KEYS).agg(*counts))
    phrase = phrases(index, query) if "phrase" in tiers else None
    if phrase is not None:
        marks.append(phrase.withColumn("phrase", F.lit(True)))
    grams = S.query_grams(query) if "gram" in tiers else []
    if grams:
        triples = [g for g in grams if len(g) == 3]
        marks.append(_in_name_grams(index, triples).select(*_KEYS).distinct().withColumn("gram", F.lit(True)))
    if not marks:
        return docs.limit(0).select("*", *[F.lit(0.0).alias(f"_{t}") for t in tiers])
    whole = marks[0]
    for more in marks[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    held = [t for t in TIERS if t in whole.columns]
    found = whole.groupBy(*_KEYS).agg(*[F.coalesce(F.max(t), F.lit(False)).alias(f"_has_{t}") for t in held])
    found = found.filter(F.greatest(*[F.col(f"_has_{t}") for t in held], F.lit(False)))
    hits = docs.join(found, _KEYS)
    worth = {
        "phrase": S.PHRASE + (S.PHRASE_WORDS if len(words) > 1 else 0.0),
        "terms": S.ALL_TERMS,
        "prefix": S.PREFIX * len(words),
        "infix": S.INFIX * len(words),
        "fuzzy": S.FUZZY * needed["fuzzy"],
    }

    def weight(tier: str) -> Column:
        if tier not in held:
            return F.lit(0.0)
        if tier == "gram":
            return F.lit(S.GRAM) * S.gram_count(query)
        return F.when(F.col(f"_has_{tier}"), F.lit(worth[tier])).otherwise(F.lit(0.0))

    return hits.select(*docs.columns, *[weight(t).alias(f"_{t}") for t in tiers])


def _in_name_grams(index: TokenIndex, triples: list[str]) -> DataFrame:
    """A name with any gram of the query has one of its triples."""
    buckets = index.name_grams.sparkSession.range(1).select(*[S._gram_bucket(F.lit(g)) for g in triples]).first()
    return index.name_grams.filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(triples))
