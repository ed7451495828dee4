"""URL filters: rules first, then templates of paths learnt per host.

A rule is a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule decides. Urls that a rule decides are the labelled examples for the
rest. Per host, paths form a tree of segments. Digit runs and hexadecimal runs are
wildcards from the start. At each depth, siblings that are too rare, or a parent's
children when most of its urls have a child of their own, become ``*``; sibling branches
of like labels and children are merged when a test of two proportions cannot tell a
branch from the merged ones. A template is rejected when the smoothed share of blocked
among its labelled urls is at least ``REJECT_AT``; one without labels is allowed.

The tree is built over distinct (host, generalised segments) with counts, so hot hosts
are pre-aggregated; segments below ``DEPTH`` count as one wildcard. A url that is null or
has no ``://`` has an empty host and path, fits no rule and is allowed. Every input row
gives one row; no rows give none.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertree.session import materialize

DEPTH = 4
MIN_COUNT = 3
#: Share of distinct children from which all of a parent's children are a variable.
VARIABLE_SHARE = 0.5
#: Critical value of the two-proportion test.
Z_LIMIT = 2.58
PRIOR_ROWS = 2.0
PRIOR_BLOCKED = 0.2
REJECT_AT = 0.5
#: Rules are part of the plan, so their number is bounded.
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, host, path)."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract("url", form, 1), F.lit(""))
    return pages.select(
        "page_id",
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.coalesce(F.regexp_extract("url", form, 2), F.lit("")).alias("path"),
    )


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as (size, text, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    fitting = [
        F.when(
            ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path),
            F.struct(
                F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fitting)))


def segments(path: Column) -> Column:
    """Generalised segments of a path, at most ``DEPTH`` + 1."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    plain = F.transform(
        parts,
        lambda s: F.regexp_replace(F.regexp_replace(s, "(?<![0-9a-zA-Z])[0-9a-f]{8,}(?![0-9a-zA-Z])", "<h>"), "[0-9]+", "<n>"),
    )
    return F.when(F.size(plain) > DEPTH, F.concat(F.slice(plain, 1, DEPTH), F.array(F.lit("*")))).otherwise(plain)


def kind(segment: Column) -> Column:
    """What sort of child a segment is: 0 none, 1 empty, 2 variable, 3 word."""
    return (
        F.when(segment.isNull(), 0).when(segment == "", 1).when(segment.rlike("<[nh]>|\\*"), 2).otherwise(3)
    )


def labelled_paths(urls: DataFrame) -> DataFrame:
    """Distinct (host, segs) with rows, labelled rows and blocked rows."""
    return urls.groupBy("host", "segs").agg(
        F.count("*").alias("n"),
        F.count("rule.verdict").alias("labelled"),
        F.count(F.when(F.col("rule.verdict") == "block", 1)).alias("blocked"),
    )


def branches(rows: DataFrame, depth: int) -> DataFrame:
    """(parent, segment, branch): the name under which each child of a template goes on."""
    child = F.try_element_at("segs", F.lit(depth))
    below = kind(F.try_element_at("segs", F.lit(depth + 1)))
    found = (
        rows.filter(child.isNotNull())
        .groupBy(F.col("host").alias("_host"), F.col("template").alias("parent"), child.alias("segment"))
        .agg(
            *(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")),
            *(F.sum(F.when(below == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)),
        )
    )
    siblings = Window.partitionBy("_host", "parent")
    share = F.count("*").over(siblings) / F.sum("n").over(siblings)
    variable = (share > VARIABLE_SHARE) & (F.sum("n").over(siblings) >= MIN_COUNT)
    rate = F.col("blocked") / F.col("labelled")
    label = F.when(F.col("labelled") == 0, "u").when(rate < 0.25, "a").when(rate > 0.75, "b").otherwise("m")
    shape = F.array_max(F.array(*(F.struct(F.col(f"k{k}").alias("rows"), F.lit(k).alias("kind")) for k in range(4))))["kind"]
    like = F.concat(label, shape.cast("string"))
    found = found.withColumns({"variable": variable, "like": like, "rare": F.col("n") < MIN_COUNT})
    merged = Window.partitionBy("_host", "parent", "like")

    def differs(part: Column, whole: Column) -> Column:
        """Whether a branch's share is unlikely to be that of the other merged branches."""
        others, others_all = F.sum(part).over(merged) - part, F.sum(whole).over(merged) - whole
        pool = F.sum(part).over(merged) / F.sum(whole).over(merged)
        spread = F.sqrt(pool * (1 - pool) * (1 / whole + 1 / others_all))
        z = F.abs(part / whole - others / others_all) / spread
        return F.coalesce((whole > 0) & (others_all > 0) & (spread > 0) & (z > Z_LIMIT), F.lit(False))

    own = F.greatest(*(F.col(f"k{k}") for k in range(4)))
    alone = differs(F.col("blocked"), F.col("labelled")) | differs(own, F.col("n")) | (F.count("*").over(merged) == 1)
    name = (
        F.when(F.col("variable") | F.col("rare"), "*")
        .when(alone, F.col("segment"))
        .otherwise(F.concat(F.lit("{"), F.min("segment").over(merged), F.lit("}")))
    )
    return found.select("_host", "parent", "segment", name.alias("branch"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segs, template, purity, verdict) of each distinct generalised path."""
    rows = materialize(labelled_paths(urls).withColumn("template", F.lit("")), "paths")
    for depth in range(1, DEPTH + 1):
        child = F.try_element_at("segs", F.lit(depth))
        names = branches(rows, depth)
        match = (
            (F.col("host") == F.col("_host")) & (F.col("template") == F.col("parent")) & (child == F.col("segment"))
        )
        longer = F.when(F.col("branch").isNotNull(), F.concat("template", F.lit("/"), "branch")).otherwise(
            F.col("template")
        )
        rows = materialize(
            rows.join(names, match, "left").withColumn("template", longer).drop("_host", "parent", "segment", "branch"),
            "paths",
        )
    found = rows.groupBy(F.col("host").alias("_host"), F.col("template").alias("_template")).agg(
        F.sum("labelled").alias("of"), F.sum("blocked").alias("bad")
    )
    purity = (F.col("bad") + PRIOR_ROWS * PRIOR_BLOCKED) / (F.col("of") + PRIOR_ROWS)
    rejected = (F.col("of") > 0) & (purity >= REJECT_AT)
    return rows.join(found, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template"))).select(
        "host", "segs", "template", purity.alias("purity"), F.when(rejected, "block").otherwise("allow").alias("verdict")
    )


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page."""
    urls = parsed(pages).withColumn("rule", rule_of(rules)).withColumn("segs", segments(F.col("path")))
    urls = materialize(urls, "urls")
    learnt = templates(urls).withColumnsRenamed({"host": "_host", "segs": "_segs", "verdict": "learnt"})
    both = urls.join(learnt, (F.col("host") == F.col("_host")) & (F.col("segs") == F.col("_segs")), "left")
    return both.select(
        "page_id", "host", "path", F.col("rule.text").alias("rule"),
        F.coalesce("rule.verdict", "learnt", F.lit("allow")).alias("verdict"), "template", "purity",
    )
