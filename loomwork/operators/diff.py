"""Differences between two states of a keyed set: trees, snapshots, documentation against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tree_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """path, action and reason for entries (path, sha, mode): download new and changed ones, keep equal ones, remove the rest."""
    p, c = prev.alias("p"), cur.alias("c")
    reason = (
        F.when(F.col("c.path").isNull(), "deleted")
        .when(F.col("p.path").isNull(), "added")
        .when(~F.col("p.sha").eqNullSafe(F.col("c.sha")), "content")
        .when(~F.col("p.mode").eqNullSafe(F.col("c.mode")), "mode")
        .otherwise("same")
    )
    joined = p.join(c, F.col("p.path") == F.col("c.path"), "full_outer").select(F.coalesce("c.path", "p.path").alias("path"), reason.alias("reason"))
    action = F.when(F.col("reason") == "deleted", "remove").when(F.col("reason") == "same", "keep").otherwise("download")
    return joined.select("path", action.alias("action"), "reason")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change of every (path, sig) that was added, modified or deleted."""
    b, a = before.alias("b"), after.alias("a")
    change = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "deleted").when(~F.col("a.sig").eqNullSafe(F.col("b.sig")), "modified")
    return b.join(a, F.col("b.path") == F.col("a.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    """added, modified, deleted and total as one row."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")], F.count(F.lit(1)).alias("total"))


def drift(documented: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key and drift: stale where only documented, missing where only actual."""
    stale = documented.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("drift", F.lit("stale"))
    missing = actual.select(key).distinct().join(documented.select(key), key, "left_anti").withColumn("drift", F.lit("missing"))
    return stale.unionByName(missing)


def reuse_or_send(local: DataFrame, remote: DataFrame, digest: str) -> DataFrame:
    """local with plan: reuse what the remote holds by digest, send the rest. Null digests are sent."""
    held = remote.select(digest).filter(F.col(digest).isNotNull()).distinct().withColumn("_held", F.lit(True))
    return local.join(held, digest, "left").select(*[F.col(c) for c in local.columns], F.when(F.col("_held"), "reuse").otherwise("send").alias("plan"))


def changed_from_last(rows: DataFrame, by: str, order: list[str | Column], value: str) -> DataFrame:
    """Adds last (the value of the row before) and moved (first, same or changed)."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows.withColumn("last", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    moved = F.when(F.col("_n") == 1, "first").when(F.col("last").eqNullSafe(F.col(value)), "same").otherwise("changed")
    return out.withColumn("moved", moved).drop("_n")
