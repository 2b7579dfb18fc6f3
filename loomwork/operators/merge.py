"""Keyed overlay merges: the right side's fields win, rows of one side alone stay or go by the kind of merge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _winner(name: str, blank_keeps: bool) -> Column:
    left, right = F.col(f"l.{name}"), F.col(f"r.{name}")
    return F.coalesce(F.nullif(right, F.lit("")), left, right) if blank_keeps else F.coalesce(right, left)


def overlay(existing: DataFrame, fresh: DataFrame, key: str, keep_left_if_blank: Iterable[str] = ()) -> DataFrame:
    """Full outer merge by key. Adds origin: kept (left alone), added (right alone) or updated."""
    l, r = existing.withColumn("_l", F.lit(True)).alias("l"), fresh.withColumn("_r", F.lit(True)).alias("r")
    names = [c for c in existing.columns if c != key]
    extra = [c for c in fresh.columns if c != key and c not in existing.columns]
    origin = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "kept").otherwise("updated")
    blank = set(keep_left_if_blank)
    both = [_winner(c, c in blank).alias(c) if c in fresh.columns else F.col(f"l.{c}") for c in names]
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer").select(F.coalesce(f"r.{key}", f"l.{key}").alias(key), *both, *[F.col(f"r.{c}") for c in extra], origin.alias("origin"))


def update_only(existing: DataFrame, fresh: DataFrame, key: str, watch: Iterable[str]) -> DataFrame:
    """Left merge by key: rows of fresh alone are dropped. Adds changed: whether a watched column differs, nulls alike."""
    watch = list(watch)
    l, r = existing.alias("l"), fresh.withColumn("_r", F.lit(True)).alias("r")
    names = [c for c in existing.columns if c != key]
    new = [(_winner(c, False) if c in fresh.columns else F.col(f"l.{c}")).alias(c) for c in names]
    differs = F.lit(False)
    for c in watch:
        differs = differs | ~F.coalesce(f"r.{c}", f"l.{c}").eqNullSafe(F.col(f"l.{c}"))
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "left").select(F.col(f"l.{key}"), *new, (F.col("_r").isNotNull() & differs).alias("changed"))


def point_update(existing: DataFrame, key: str, value, changes: dict[str, Column]) -> DataFrame:
    """One row's columns replaced; touched says which row it was. A value that isn't there leaves all rows as they are."""
    here = F.col(key).eqNullSafe(F.lit(value))
    return existing.select(*[F.when(here, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in existing.columns], here.alias("touched"))


def prune_scoped(index: DataFrame, scanned: DataFrame, key: str, owner: str, scope) -> DataFrame:
    """Adds stays: rows that were scanned, and rows whose owner is known and outside the scope, stay."""
    seen = scanned.select(key).distinct().withColumn("_seen", F.lit(True))
    foreign = F.coalesce(F.col(owner).cast("string") != str(scope), F.lit(False))
    return index.join(seen, key, "left").select(*[F.col(c) for c in index.columns], (F.col("_seen").isNotNull() | foreign).alias("stays"))


def with_state(seed: DataFrame, state: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every seed row with its state, or the defaults where it has none."""
    joined = seed.join(state.select(key, *defaults), key, "left")
    return joined.select(*[F.col(c) for c in seed.columns], *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def first_of_unions(parts: list[DataFrame], key: str, *order: Column) -> DataFrame:
    """Union in the given order of preference; of each key the row of the first part stays, ties by order."""
    from pyspark.sql import Window

    rows = None
    for n, part in enumerate(parts):
        part = part.withColumn("part", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    best = F.row_number().over(Window.partitionBy(key).orderBy("part", *order))
    return rows.withColumn("_n", best).filter(F.col("_n") == 1).drop("_n")
