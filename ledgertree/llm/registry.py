"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgertree.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


#: Bytes of an Arrow batch that a Python worker gets at once.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package's code to its Python workers, once per application."""
    # Texts may be long: batches are bounded in bytes, not only in rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in package.rglob("*.py"):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as set it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back, and the shuffle files of what made it let go.

    Spark deletes the files of a shuffle once the driver's garbage collection finds it
    unused, which may be long after; a step that moves much data should not wait for that.
    """
    out = materialize(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def shipped(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``build``, whose first argument is the session, with the code handed out before."""

    @wraps(build)
    def run(spark: SparkSession, *args):
        ship(spark)
        return build(spark, *args)

    return run


def query(key: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = shipped(build)
        if check is not None:
            CHECKS[key] = check
        return QUERIES[key]

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
