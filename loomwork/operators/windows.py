"""Operators that look along an order: latest, first, last n, islands of failures, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_with_text(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The text of the last row of each group whose text isn't blank."""
    said = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return said.groupBy(by).agg(F.max(order).alias(order), F.max_by(text, order).alias(text))


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") == 1).drop("_n")


def last_n(rows: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The last n rows of each group, with place 1 for the last. Spark cuts groups before the shuffle (group limits)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def failure_runs(rows: DataFrame, by: str, order: list[str], ok: Column, at: str, limit: int = 3) -> DataFrame:
    """State after each group's last row: failures since the last success, disabled from limit on, and the times of both."""
    w = Window.partitionBy(by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.select(by, *order, F.col(at).alias("_at"), ok.alias("_ok")).withColumn("_island", F.sum(F.col("_ok").cast("int")).over(upto))
    tails = marked.groupBy(by, "_island").agg(F.count_if(~F.col("_ok")).alias("failures"), F.max(F.when(F.col("_ok"), F.col("_at"))).alias("ok_at"), F.max(F.when(~F.col("_ok"), F.col("_at"))).alias("fail_at"))
    state = tails.groupBy(by).agg(F.max_by("failures", "_island").alias("failures"), F.max("ok_at").alias("last_ok_at"), F.max("fail_at").alias("last_fail_at"))
    return state.withColumn("disabled", F.col("failures") >= limit)


def last_progress(rows: DataFrame, by: str, order: list[str], value: str, at: str) -> DataFrame:
    """When each group's value last rose above the row before; the first row counts as progress."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.lag(value).over(w)
    moved = rows.select(by, F.col(at).alias("_at"), (before.isNull() | (F.col(value) > before)).alias("_rose"))
    return moved.groupBy(by).agg(F.max(F.when(F.col("_rose"), F.col("_at"))).alias("last_progress_at"), F.count_if("_rose").alias("steps"))
