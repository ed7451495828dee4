"""Mixing sources to target weights, with DataFrame operations alone.

Each source's documents are packed, in order of their ids, into blocks of ``BLOCK`` words.
A source's target is its share of all words by weight, at most ``MAX_EPOCHS`` times its
size; what the limit cuts off is shared out again by weight (water filling, in closed
form). Targets become whole numbers of output slots. A pseudorandom permutation of all
slots deals them to the output shards, so a shard's counts of slots per source are a
multinomial draw under the condition that the totals are met. A source's slots pass
through another permutation of its block numbers, once per epoch, and the mix is the join
of slots and blocks on (source, block).

Permutations are swap-or-not networks over integers, so any number of slots works without
a sort, and reruns agree. Running sums have two levels: inside runs of ``RUN`` consecutive
ids and over the runs' totals, so a source with a third of all rows is spread over tasks.

Null and empty texts have size 0 and are never taken. A null source is a source, last in
order. Repeated rows count as often as they come. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertree.llm.registry import free_names
from ledgertree.session import materialize

BLOCK = 64
SHARD_SLOTS = 1024
MAX_EPOCHS = 3
RUN = 4096
#: Slots that one row is expanded into.
CHUNK = 16_384
ROUNDS = 8
#: Sides of the coin that decides over a fraction of a copy.
COINS = 1 << 30
PRIME = 2_147_483_647
WORD = r"[^\x20\x09-\x0D]+"


def round_keys(stream: int) -> list[tuple[int, int, int]]:
    """(reflection, factor, offset) of each round of one family of permutations."""
    state, out = 12_345 + 7_919 * stream, []
    for _ in range(ROUNDS):
        numbers = []
        for _ in range(3):
            state = (state * 48_271 + 11) % PRIME
            numbers.append(state | 1)
        out.append(tuple(numbers))
    return out


def reflected(key: int | str, x: str, n: str, seed: str) -> str:
    """The partner of ``x`` in one round, as SQL."""
    return f"(({key} + {seed} * 7919) % {PRIME} % {n} - {x} + {n}) % {n}"


def swapped(factor: int | str, offset: int | str, x: str, y: str, seed: str) -> str:
    """``x`` or its partner ``y``; both get the same coin, as SQL."""
    coin = f"((greatest({x}, {y}) % {PRIME}) * {factor} + {offset} + {seed} * 104729) % {PRIME} % 131072"
    return f"case when {coin} >= 65536 then {y} else {x} end"


def permuted(df: DataFrame, x: str, n: str, seed: str, out: str, stream: int) -> DataFrame:
    """``df`` with ``out``, the place of ``x`` in a permutation of 0..n-1 chosen by ``seed``."""
    keys = ", ".join(
        f"named_struct('key', {k}L, 'factor', {f}L, 'offset', {o}L)" for k, f, o in round_keys(stream)
    )
    partner = f"({reflected('r.key', 'a', n, seed)})"
    step = swapped("r.factor", "r.offset", "a", partner, seed)
    return df.withColumn(out, F.expr(f"aggregate(array({keys}), {x}, (a, r) -> {step})"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each row, written once; texts are read this once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return materialize(docs.select("doc_id", F.col("source").cast("string"), size.alias("size")), "sizes")


def sources(sizes: DataFrame, weights: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per source: its number, size, target, blocks, slots and first slot.

    ``weights`` is an expression over the source number ``sid`` (from 1, by code point).
    """
    everything = Window.partitionBy()
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long")
    )
    weight = (F.col("sid") - 1) % 3 + 1 if weights is None else weights
    found = found.withColumn("weight", weight.cast("double"))
    cap = (F.col("source_size") * MAX_EPOCHS).cast("double")
    filled = Window.orderBy(cap / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("source_size").over(filled) * MAX_EPOCHS, F.lit(0)
    )
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    found = found.withColumn("level", left.cast("double") / share)
    # The level rises while sources are capped and falls after, so the largest is the right one.
    found = found.withColumn("target", F.least(cap, F.max("level").over(everything) * F.col("weight")))
    found = found.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
    found = found.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn(
        "all_slots", F.sum("slots").over(everything)
    )


def placed(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """Each row of ``sizes`` with its source's columns and ``start``, its first word's place in the source."""
    rows = sizes.withColumnRenamed("source", "_source").join(
        table, F.col("_source").eqNullSafe(F.col("source"))
    ).drop("_source")
    rows = rows.withColumn("run", F.floor(F.col("doc_id") / RUN))
    runs = rows.groupBy("sid", "run").agg(F.sum("size").alias("run_size"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("sid").alias("_sid"), F.col("run").alias("_run"),
        F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("run_start"),
    )
    rows = rows.join(runs, (F.col("sid") == F.col("_sid")) & F.col("run").eqNullSafe(F.col("_run")))
    inside = Window.partitionBy("sid", "run").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("run_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("start", start).drop("_sid", "_run", "run", "run_start")


def slots(table: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: (shard, slot, sid, block), one row per slot of the output."""
    spark = table.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table.select("sid", "blocks", "slots", "first_slot", "all_slots").filter("slots > 0")
    parts = table.withColumn("part", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})"))).repartition(
        n, "sid", "part"
    )
    last = F.least((F.col("part") + 1) * CHUNK, F.col("slots")) - 1
    ranks = parts.withColumn("rank", F.explode(F.sequence(F.col("part") * CHUNK, last)))
    ranks = ranks.withColumn("place", F.col("first_slot") + F.col("rank")).withColumn("zero", F.lit(0).cast("long"))
    ranks = ranks.withColumn("turn", F.col("rank") % F.col("blocks"))
    dealt = permuted(ranks, "place", "all_slots", "zero", "slot", 1)
    dealt = permuted(dealt, "turn", "blocks", "sid", "block", 2)
    return dealt.select(F.expr(f"slot div {shard_slots}").alias("shard"), "slot", "sid", "block")


def shard_counts(mix: DataFrame) -> DataFrame:
    """Slots of each source in each output shard."""
    return mix.groupBy("shard", "sid").agg(F.count("*").alias("n_slots"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, block, start, words): the part of a document that lies in one block."""
    whole = rows.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    )
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return whole.select(
        "sid", "block", "start", (end - F.greatest(F.col("start"), F.col("block") * block)).alias("words")
    )


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of ``docs``."""
    sizes = sized(docs)
    table = materialize(sources(sizes), "sources")
    rows = materialize(placed(sizes, table), "places")
    times = slots(table).groupBy("sid", "block").agg(F.count("*").alias("times"))
    # The planner takes the few sources for the size of all slots; never broadcast those.
    used = pieces(rows).join(times.hint("merge"), ["sid", "block"])
    used = used.groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # A start is unique among the documents with words; the others take nothing.
    used = used.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken")
    match = (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return rows.join(used, match, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes its words; rows not taken go.

    A row comes taken / size times, rounded down, and once more with the fraction as its
    probability. The coin is a hash of the row, so reruns agree and a source's words meet
    its target whatever the length of its documents. Equal rows share their coin: they come
    equally often.
    """
    own_id, own_source, share_of, times, copy = free_names(docs.columns, "_id", "_source", "_share", "_times", "_copy")
    taken = taken_words(docs).filter("size > 0").groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source))
    share = taken.agg((F.sum("taken") / F.sum("size")).alias(share_of)).filter(F.col(share_of) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").cast("string").eqNullSafe(F.col(own_source))
    coin = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "source", "text"), F.lit(COINS)) / COINS
    # One row for each id, which grow with the documents: never broadcast.
    kept = docs.join(share.hint("merge"), same).withColumn(times, F.floor(F.col(share_of) + coin).cast("int"))
    kept = kept.filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return kept.select(*docs.columns)
