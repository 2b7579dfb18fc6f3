"""Marked blocks in texts, and the tables and trees that are written into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths, strings


def block(text: Column, begin: str, end: str) -> Column:
    """What stands between two markers, trimmed; null where either is missing."""
    a = F.instr(text, begin)
    rest = F.substring(text, a + len(begin), F.length(text))
    b = F.instr(rest, end)
    return F.when((a > 0) & (b > 0), strings.stripped(F.substring(rest, F.lit(1), b - 1)))


def replaced(text: Column, begin: str, end: str, content: Column) -> Column:
    """The text with a new block between the markers; unchanged where either is missing."""
    a = F.instr(text, begin)
    rest = F.substring(text, a + len(begin), F.length(text))
    b = F.instr(rest, end)
    whole = F.concat(F.substring(text, F.lit(1), a + len(begin) - 1), F.lit("\n"), content, F.lit("\n"), F.substring(rest, b, F.length(rest)))
    return F.when((a > 0) & (b > 0), whole).otherwise(text)


def drifted(text: Column, begin: str, end: str, content: Column) -> Column:
    return ~block(text, begin, end).eqNullSafe(strings.stripped(content))


def table_lines(rows: DataFrame, by: list[str], columns: list[str], order: str) -> DataFrame:
    """by and lines: each group's rows as one table text, in order. Groups are files or versions, so their rows are few."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(head + "\n"), body).alias("lines"))


def tree_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """first, second, files directly there and how many lie deeper: the two upper levels of a file tree."""
    s = paths.segments(F.col(path))
    two = files.select(F.get(s, F.lit(0)).alias("first"), F.when(F.size(s) > 2, F.get(s, F.lit(1))).alias("second"), (F.size(s) > 3).alias("deep"))
    return two.groupBy("first", "second").agg(F.count_if(~F.col("deep")).alias("files"), F.count_if("deep").alias("deeper"))


def guarded(new: DataFrame, old: DataFrame) -> DataFrame:
    """new, after making sure that it has rows, and no fewer than old. An error is raised otherwise."""
    n, m = new.count(), old.count()
    if n == 0 or n < m:
        raise ValueError(f"the new table has {n} rows, the old one {m}")
    return new
