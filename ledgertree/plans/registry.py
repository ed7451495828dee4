"""Collecting queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.plans.fixtures import VIEWS, Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Named subqueries a check may refer to, in dependency order.
PARTS: dict[str, str] = {}


def part(name: str, columns: str, body: str) -> None:
    PARTS[name] = f"{name}{columns} as ({body})"


for _name, _text in VIEWS.items():
    part(_name, "", _text)


def query(key: str, check: str | None = None):
    def register(build: Callable[[Fixtures], DataFrame]):
        QUERIES[key] = build
        if check is not None:
            CHECKS[key] = check
        return build

    return register


def stamp(column: str) -> str:
    """A time as text, in the checking SQL."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def present(df: DataFrame) -> DataFrame:
    """Times as text and integers as long, so that both engines print alike."""
    columns = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(field.name)
        if kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        elif kind in ("integer", "short", "byte"):
            col = col.cast("long").alias(field.name)
        columns.append(col)
    return df.select(*columns)


def runnable(build: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: present(build(Fixtures(spark, sf_dir)))


def check_sql(key: str) -> str:
    """The check with every named subquery it needs in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(CHECKS[key])
    head = ",\n".join(PARTS[name] for name in PARTS if name in needed)
    return f"with recursive {head}\n{CHECKS[key]}" if head else CHECKS[key]
