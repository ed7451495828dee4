"""Read-only SQL over the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgertree.sources.tables import to_json_rows

# Functions that call any Java method, and plan nodes that run a program or name a
# relation that is known only later.
_CALLS = re.compile(r"\b(reflect|try_reflect|java_method)\(", re.IGNORECASE)
_NODES = ("ScriptTransformation", "UnresolvedIdentifier", "UnresolvedInlineTable [reflect")
_registered: dict[str, set[str]] = {}


class NotAllowed(ValueError):
    """The statement does more than read the registered tables."""


def _names(spark: SparkSession) -> set[str]:
    """Tables registered in this session, which alone sees its views."""
    return _registered.setdefault(spark._jsparkSession.sessionUUID(), set())


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        _names(df.sparkSession).add(name.lower())


def read_only_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run one query over registered tables; anything else is refused.

    The text is placed where only a query may stand, so commands, writes and a second
    statement fail in Spark's own parser. In the parsed plan, subqueries included, every
    relation must be a registered table or the name of a ``with`` clause; files by path,
    reflection and scripts are refused. An alias makes no name known, and a ``with`` name
    that some other table or view also has is refused, since it may be used out of its scope.
    """
    whole = f"select * from (\n{text.strip().rstrip(';')}\n)"
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(whole).toString()
    if (call := _CALLS.search(plan)) or any(node in plan for node in _NODES):
        raise NotAllowed(f"not read-only: {call[1] if call else 'script or late name'}")
    known = _names(spark)
    own = {name.strip().lower() for names in re.findall(r"\bCTE \[(.*?)\]", plan) for name in names.split(",")}
    for found in re.findall(r"UnresolvedRelation \[(.*?)\](?:, \[|\n|$)", plan):
        name = found.lower()
        if name not in known and (name not in own or spark.catalog.tableExists(found)):
            raise NotAllowed(f"not a registered table: {found}")
    return spark.sql(whole)


def read_only_json(spark: SparkSession, text: str) -> DataFrame:
    return to_json_rows(read_only_sql(spark, text))
