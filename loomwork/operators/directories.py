"""Marks that a directory hands down to all below it, and listings of directories in collated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, paths

# Empty files that exempt their directory: one whose findings are shown and don't block, one that isn't looked at.
SHOWN_ONLY, NOT_READ = ".samples", ".test"


def _plain(path: Column) -> Column:
    """A path with forward slashes, dots followed; null where it leaves the root."""
    given = F.replace(path, F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(given, "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return F.when(depth["low"] >= 0, parse.resolved(F.lit(""), given))


def marked_by(files: DataFrame, listing: DataFrame, name: str, by: str, path: str = "path", size: str = "size") -> DataFrame:
    """files with the nearest directory above each, the root being blank, that holds an empty file called name in the listing (path, size); null without one, and for paths that leave the root.

    Directories are what is asked, not files: each different one once, with its ancestors.
    """
    held = listing.filter((paths.basename(F.col(path)) == name) & (F.col(size) == 0)).select(paths.dirname(_plain(F.col(path))).alias("_up")).filter(F.col("_up").isNotNull()).distinct()
    placed = files.withColumn("_dir", paths.dirname(_plain(F.col(path))))
    dirs = placed.select("_dir").filter(F.col("_dir").isNotNull()).distinct()
    chain = F.concat(F.array(F.lit("")), paths.ancestors(F.col("_dir")), F.when(F.col("_dir") != "", F.array("_dir")).otherwise(F.array().cast("array<string>")))
    met = dirs.select("_dir", F.explode(chain).alias("_up")).join(held, "_up").groupBy("_dir").agg(F.max_by("_up", F.length("_up")).alias(by))
    return placed.join(met, "_dir", "left").drop("_dir")


def judged(findings: DataFrame, listing: DataFrame, file: str = "file", path: str = "path", size: str = "size") -> DataFrame:
    """findings without those in directories that aren't read, with shown_only: whether their directory keeps them from blocking."""
    one = marked_by(findings.withColumnRenamed(file, path) if file != path else findings, listing, NOT_READ, "_unread", path, size)
    two = marked_by(one.filter(F.col("_unread").isNull()).drop("_unread"), listing, SHOWN_ONLY, "_shown", path, size)
    out = two.withColumn("shown_only", F.col("_shown").isNotNull()).drop("_shown")
    return out.withColumnRenamed(path, file) if file != path else out


def collated(rows: DataFrame, by: list[str], name: str, most: int | None = None, collation: str = "UNICODE") -> DataFrame:
    """rows with place, from 1, of name within by in the order of an ICU collation (UNICODE, zh, de, ...), then by code points; the first most alone.

    Plain string order puts all upper case before all lower case and Chinese names by their code
    points; a collation puts them as readers of its language do.
    """
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.collate(F.col(name), collation), F.col(name)))
    out = rows.withColumn("place", order.cast("long"))
    return out if most is None else out.filter(F.col("place") <= most)


def children(paths_: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """name of each directory right under a folder, hidden ones left out, of the paths of files."""
    rest = F.substring(F.col(path), len(folder.rstrip("/")) + 2, 1_000_000) if folder else F.col(path)
    under = paths_.filter(paths.within(folder, F.col(path))) if folder else paths_
    parts = F.split(rest, "/")
    return under.filter(F.size(parts) > 1).select(F.get(parts, F.lit(0)).alias("name")).filter(~F.col("name").startswith(".") & (F.col("name") != "")).distinct()
