"""All queries of this subpackage."""

from ledgertree.llm import dedup_queries, mixing_queries, page_queries, period_queries, text_queries, token_queries, vector_queries  # noqa: F401
from ledgertree.llm.registry import CHECKS, QUERIES  # noqa: F401
