"""Set operators over one key column, and over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each distinct key of either side, with side both, left or right."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return l.join(r, key, "full_outer").select(key, side.alias("side"))


def hit_sides(rows: DataFrame, left: str, right: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows where either column is wanted, with side both, left or right. Case doesn't count in strings."""
    same = lambda df, c: F.lower(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c)
    w = wanted.select(same(wanted, key).alias("_w")).distinct()
    a, b = w.withColumn("_a", F.lit(True)), w.withColumnRenamed("_w", "_v").withColumn("_b", F.lit(True))
    joined = rows.join(a, same(rows, left) == F.col("_w"), "left").join(b, same(rows, right) == F.col("_v"), "left")
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").when(F.col("_b"), "right")
    return joined.select(*[F.col(c) for c in rows.columns], side.alias("side")).filter("side IS NOT NULL")


def edited(current: Column, given: Column, mode: str) -> Column:
    """A list after set, add, remove or clear; order of first occurrence is kept."""
    return {"set": F.array_distinct(given), "add": F.array_union(current, given), "remove": F.array_except(current, given), "clear": F.slice(current, 1, 0)}[mode]
