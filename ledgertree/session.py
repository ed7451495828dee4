"""Session set-up and the two ways this package touches shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "ledgertree", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: whatever ``spark.checkpoint.dir`` names.

    Every executor must reach it, so on a cluster the setting is required. Only
    a local master, as in tests, gets a temporary folder when it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="ledgertree-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


_scopes: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope for intermediate tables: all written inside go when it ends.

    Results that read them must be written or collected inside.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        files(spark, folder).delete(hadoop_path(spark, folder), True)


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):
    """The file system that holds ``path``."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scopes[-1] if _scopes else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has, before a step that makes many rows of each.

    Such a table may be one small file, and its size on disk tells nothing of the work. The number
    is given, so that small partitions are not put together again.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage so that iterative plans stay small, survives the loss
    of executors, and gives the planner real sizes to choose joins from.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
