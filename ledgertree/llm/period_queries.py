"""Periodic runs in all documents, some of them made periodic first: op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.llm import periodic_runs
from ledgertree.llm.registry import query, table


def cycled(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth document, by the hash of its id, cycles through a stretch of itself.

    A null id has no hash, and its text stays as it is.
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.col("g")
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest, cycle = n - F.col("a"), F.slice("words", F.col("a") + 1, F.col("p"))
    rounds = F.ceil(rest / F.col("p")).cast("int")
    turned = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(cycle, rounds)), F.lit(1), rest))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The runs of each row in figures: how many, the greatest, and hashes of runs and kept words."""
    greatest = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.withColumn("greatest", greatest)
    length, period = F.col("greatest.length"), -F.col("greatest.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("greatest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_periodic_runs")
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs.periodic_runs(cycled(table(spark, sf_dir, "documents"))))
