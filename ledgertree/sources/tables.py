"""Typed load and save of the package's tables, and JSON rows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.schema import TABLES
from ledgertree.session import files, hadoop_path

# Sort order inside the files: lets range predicates skip row groups.
_LAYOUT = {"mutation_log": ["volume", "sequence"], "facts": ["volume", "file_id"]}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared schema; columns the input lacks become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def save(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """Write one table under ``root``; see :func:`write`."""
    return write(df, f"{root}/{name}", name, mode)


def write(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> str:
    """Write the table ``name`` to a folder.

    Log and facts are range-partitioned before the write, so a volume holding
    much of the data is spread over many files, and partitioned by volume on
    disk, so that a query for one volume reads only its folder. Their files carry
    Bloom filters of the ids, for lookups that no sort order serves.
    """
    out = conform(df, name)
    if name in _LAYOUT:
        keys = _LAYOUT[name]
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = out.write.mode(mode).partitionBy("volume")
        for column in ("file_id", "parent_file_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
    else:
        out.write.mode(mode).parquet(path)
    return path


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(f"{root}/{name}").select(*schema.names)


def publish(df: DataFrame, root: str, name: str) -> int:
    """Write a new version of a table, for results that read the old one.

    The rows go to a folder of their own, which no other write touches. A version
    exists once its file in ``commits`` does; that file is created exclusively, so of
    two writers one takes the next number, and a failed write leaves the table whole.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    write(df, f"{root}/{name}/{folder}", name)
    number = versions(spark, root, name) + 1
    while not _commit(spark, f"{root}/{name}/commits/{number}", folder):
        number += 1
    return number


def _commit(spark: SparkSession, pointer: str, folder: str) -> bool:
    """Create ``pointer`` with the name of the folder; False if it exists."""
    target = hadoop_path(spark, pointer)
    system = files(spark, pointer)
    if system.exists(target):
        return False
    try:
        out = system.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def versions(spark: SparkSession, root: str, name: str) -> int:
    """Highest version present; 0 when there is none."""
    folder = f"{root}/{name}/commits"
    system, path = files(spark, folder), hadoop_path(spark, folder)
    if not system.exists(path):
        return 0
    return max((int(s.getPath().getName()) for s in system.listStatus(path) if s.getPath().getName().isdigit()), default=0)


def current(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The latest version of a published table, or the given one."""
    number = versions(spark, root, name) if version is None else version
    pointer = f"{root}/{name}/commits/{number}"
    if number < 1 or not files(spark, pointer).exists(hadoop_path(spark, pointer)):
        raise LookupError(f"no version {number} of {name} under {root}")
    folder = spark.read.text(pointer, wholetext=True).first()[0].strip()
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(f"{root}/{name}/{folder}").select(*schema.names)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text; NULL fields are kept, binary becomes text."""
    columns = [
        F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def compact(spark: SparkSession, root: str, name: str, target: str, files: int | None = None) -> str:
    """Rewrite a table into few sorted files under ``target``."""
    df = load(spark, root, name)
    if files is not None and name in _LAYOUT:
        keys = _LAYOUT[name]
        path = f"{target}/{name}"
        df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(
            "volume"
        ).parquet(path)
        return path
    return save(df, target, name)
