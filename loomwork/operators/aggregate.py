"""Roll-ups: conditional totals, histograms, staleness, versions, path segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_split(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """Counts and sums on both sides of a size limit; 0 means no limit."""
    fits = F.lit(True) if limit == 0 else size <= limit
    return rows.agg(
        F.count_if(fits).alias("kept"),
        F.coalesce(F.sum(F.when(fits, size)), F.lit(0)).alias("kept_size"),
        F.count_if(~fits).alias("skipped"),
        F.coalesce(F.sum(F.when(~fits, size)), F.lit(0)).alias("skipped_size"),
        (F.count_if(fits) == 0).alias("empty"),
    )


def occurrences(rows: DataFrame, key: str, text: str, needle: str, url_like: str) -> DataFrame:
    """For each row of key: lines that hold the needle, and those of them that look like urls."""
    lines = rows.select(key, F.explode(F.split(text, "\n")).alias("line")).filter(F.contains("line", F.lit(needle)))
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("line").rlike(url_like)).alias("url_hits"))


def distinct_across(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Distinct non-null values over several columns of each group."""
    one = rows.select(by, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).filter("value IS NOT NULL")
    return one.distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("smallest"))


def histogram(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def staleness(rows: DataFrame, by: list[str], at: str, now: Column, ttl: str) -> DataFrame:
    """newest, unknown (rows without a time) and stale: nothing known, or older than ttl."""
    out = rows.groupBy(*by).agg(F.max(at).alias("newest"), F.count_if(F.col(at).isNull()).alias("unknown"))
    return out.withColumn("stale", F.col("newest").isNull() | (F.col("newest") < now - F.expr(f"INTERVAL {ttl}")))


def bottom(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def known_first(rows: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Adds rank: place in the known order, or one more than the last for the rest."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(key))
    return rows.withColumn("rank", F.when(place > 0, place).otherwise(len(known) + 1).cast("int"))


def percent(part: Column, whole: Column, most: int = 99) -> Column:
    """Floor of the percentage, at most `most`; 0 where the whole is 0 or unknown."""
    return F.when(F.coalesce(whole, F.lit(0)) > 0, F.least(F.lit(most), F.floor(part * 100 / whole).cast("int"))).otherwise(0)


def highest_version(rows: DataFrame, version: Column, by: list[str] | None = None) -> DataFrame:
    """The largest of versions given as struct<major, minor, patch>, numerically."""
    return rows.filter(version.isNotNull()).groupBy(*(by or [])).agg(F.max(version).alias("highest"))
