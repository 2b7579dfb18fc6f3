"""Files and repositories of a workspace as tables, from Spark's own file listing."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import paths, strings

SKIPPED = ["node_modules"]


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (relative), size and modified of every file under root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return files.select(F.substring(bare, F.lit(len(root.rstrip("/")) + 2), F.length(bare)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, root: str, glob: str = "*", most: int = 512 * 1024) -> DataFrame:
    """path and text of files up to a size; binary contents (with NUL) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).filter(F.col("length") <= most)
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.substring(bare, F.lit(len(root.rstrip("/")) + 2), F.length(bare)).alias("path"), text.alias("text")).filter("text IS NOT NULL AND NOT contains(text, '\x00')")


class RepositorySource(DataSource):
    """Directories that hold a marker (.git), found by walking: Spark's own listing leaves out names that begin with a dot.

    One partition for each directory right below the root. The root must be mounted on all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "path string, depth int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Walk(self.options["path"], int(self.options.get("depth", "20")), self.options.get("marker", ".git"))


class _Walk(DataSourceReader):
    def __init__(self, root: str, depth: int, marker: str) -> None:
        self.root, self.depth, self.marker = root, depth, marker

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and self._open(e.name))
        return [InputPartition("")] + [InputPartition(d) for d in below]

    def _open(self, name: str) -> bool:
        return name not in SKIPPED and not name.startswith(".")

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        todo = [partition.value]
        while todo:
            at = todo.pop()
            level = at.count("/") + 1 if at else 0
            entries = list(os.scandir(os.path.join(self.root, at)))
            if any(e.name == self.marker for e in entries):
                yield at, level
            if at and level < self.depth:
                todo += [f"{at}/{e.name}" for e in entries if e.is_dir(follow_symlinks=False) and self._open(e.name)]


def repositories(spark: SparkSession, root: str, depth: int = 20, most: int = 200, ignored: DataFrame | None = None) -> DataFrame:
    """path of each repository at most depth levels below root ('' is the root itself), outside ignored (path) subtrees, the first `most` by path."""
    spark.dataSource.register(RepositorySource)
    repos = spark.read.format("workspace").option("depth", depth).load(root).select("path")
    if ignored is not None:
        up = repos.select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("dir"))
        hidden = up.join(ignored.select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
        repos = repos.join(hidden, "path", "left_anti")
    return repos.orderBy("path").limit(most)


def probe_row(path: Column, branch: Column, remote: Column, porcelain: Column, last: Column, upstream: Column, counts: Column) -> Column:
    """A repository's row from the texts of its probes; ahead and behind stay null where they aren't known."""
    number = lambda i: F.get(F.split(strings.stripped(counts), r"\s+"), F.lit(i)).try_cast("int")
    lines = F.filter(F.split(porcelain, "\n"), lambda s: F.trim(s) != "")
    trim = strings.stripped
    base = F.coalesce(F.nullif(trim(upstream), F.lit("")), F.concat(F.lit("origin/"), trim(branch)))
    return F.struct(
        paths.basename(path).alias("name"),
        path.alias("path"),
        trim(branch).alias("branch"),
        trim(remote).alias("remote"),
        F.size(lines).alias("changed"),
        trim(last).alias("last_commit"),
        (trim(F.coalesce(remote, F.lit(""))) != "").alias("has_remote"),
        base.alias("upstream"),
        number(0).alias("ahead"),
        number(1).alias("behind"),
    )


def porcelain_changes(status: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """keep, status (A, M, D) and path of each line of a short status; untracked files count as added, renames by their new path."""
    lines = status.select(*keep, F.explode(F.split(text, "\n")).alias("line")).filter(F.length("line") > 3)
    code = F.substring("line", 1, 2)
    kind = F.when(code == "??", "A").otherwise(F.left(F.trim(code), F.lit(1)))
    path = F.regexp_replace(F.substring_index(F.substring(F.col("line"), F.lit(4), F.length("line")), " -> ", -1), r'^"|"$', "")
    return lines.select(*keep, F.when(kind == "R", "A").otherwise(kind).alias("status"), path.alias("path")).filter(F.col("status").rlike("^[AMD]$"))


def delimited_log(lines: DataFrame, names: list[str], sep: str = "\x1f", value: str = "value") -> DataFrame:
    """Columns of a log whose fields a separator divides; short lines have nulls."""
    cut = F.split(value, "\\Q" + sep + "\\E", -1)
    return lines.filter(F.trim(value) != "").select(*[F.get(cut, F.lit(i)).alias(n) for i, n in enumerate(names)])
