"""Queries over web pages: op5 and op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgertree.llm import url_filters, warc
from ledgertree.llm.registry import query, table
from ledgertree.llm.url_filters import Rule
from ledgertree.session import new_path

RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


@query("op5_url_filters")
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), RULES)


@query(
    "op8_warc",
    """
with payloads as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as size from pages
), kept as (
  select *, case when size >= 1000 then max(page_id) over (partition by body) else page_id end as keeper from payloads
)
select page_id, size as payload_bytes, sha1(body) as payload_digest,
  case when keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from kept
""",
)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_records(spark, path)).drop("problem")
