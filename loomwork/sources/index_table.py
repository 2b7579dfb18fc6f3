"""A table that is replaced as a whole or not at all: staged, guarded, then moved into place, the old one kept in .trash.

The rows are written by Spark's own committer to a staging folder beside the table, so a failing task
leaves the table as it was; the driver then counts what was staged, refuses a write that loses too
much, and renames. Folders are any that Spark's readers know, not local ones alone. Two writers of
one table at a time must be kept apart by their caller.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks


class ShrinkRefused(ValueError):
    """A write would have lost more rows than it may."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, and no rows where there is none yet."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _moved(spark: SparkSession, source: str, target: str) -> None:
    files, at = _files(spark, source)
    _, to = _files(spark, target)
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{source} couldn't be moved to {target}")


def replace(rows: DataFrame, path: str, least_share: float = 0.5, guarded_from: int = 10, trash: str = ".trash") -> str | None:
    """Puts rows in the place of the table at path and returns where the old one went, if there was one.

    A table of guarded_from rows or more may not shrink below least_share of them; ShrinkRefused
    leaves it, and no staging folder, behind. rows may be read from the table itself.
    """
    spark, name = rows.sparkSession, path.rstrip("/").rsplit("/", 1)[-1]
    folder = path.rstrip("/")[: -len(name) - 1]
    staged = f"{folder}/.staging-{name}-{uuid.uuid4().hex}"
    old = None
    try:
        rows.write.json(staged)
        if exists(spark, path):
            before, after = spark.read.schema(rows.schema).json(path).count(), spark.read.schema(rows.schema).json(staged).count()
            if before >= guarded_from and after < least_share * before:
                raise ShrinkRefused(f"{path} has {before} rows, and {after} would be left")
            old = f"{folder}/{trash}/{name}-{uuid.uuid4().hex}"
            _moved(spark, path, old)
        try:
            _moved(spark, staged, path)
        except Exception:
            if old:
                _moved(spark, old, path)
            raise
    finally:
        files, at = _files(spark, staged)
        files.delete(at, True)
    return old


def update(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame], **guard) -> str | None:
    """Reads the table, applies change to it and puts the result in its place."""
    return replace(change(read(spark, path, schema)), path, **guard)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, **guard) -> str | None:
    """Rows by key into the table: those of rows replace those that it has; the rest stays."""
    schema = rows.schema

    def merged(now: DataFrame) -> DataFrame:
        return now.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)

    held = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return replace(merged(held), path, **guard)


def migrated(spark: SparkSession, legacy: str, path: str, schema: str, tag: str = "_t", kind: str = "index") -> str | None:
    """Brings an old table of tagged lines under its new name: rows of one kind, the old folder into .trash. Nothing happens without it, or if the new one is there."""
    if not exists(spark, legacy) or exists(spark, path):
        return None
    lines = spark.read.schema(f"{schema}, {tag} string").json(legacy)
    replace(lines.filter(F.coalesce(F.col(tag), F.lit(kind)) == kind).drop(tag), path)
    name = legacy.rstrip("/").rsplit("/", 1)
    gone = f"{name[0]}/.trash/{name[1]}-{uuid.uuid4().hex}"
    _moved(spark, legacy, gone)
    return gone
