"""A run's scope: the files that a commit's paths and the state of a working tree leave of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of a run that are held as one array.
MANY = 64


def scoped_run(runs: DataFrame, scopes: DataFrame, changed: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """run, scoped and path, a row for each file that a run is to look at; runs without any have a null path, and look at everything.

    scopes (run, path) has the files and folders that a run's commit names, changed (run, path) the files
    that differ in its working tree. A run is scoped if it names something and a changed file lies in
    it. Changed files are dealt by their run, once and as they are, and meet its names there as an array; of runs
    that name more than MANY, a file meets its own path and folders above it, so that not all pairs are compared.
    """
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    named = scopes.select(run, F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), "/+$", "").alias("_up")).filter("_up <> ''").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(run)))
    few = named.filter(F.col("_n") <= MANY).groupBy(run).agg(F.collect_set("_up").alias("_ups"))
    files = changed.filter(F.size(parts) > 0).select(run, path)
    inside = files.join(few, run).filter(F.arrays_overlap("_ups", ups)).select(run, path)
    many = named.filter(F.col("_n") > MANY).select(run, "_up").distinct()
    if not many.isEmpty():
        inside = inside.unionByName(files.join(many.select(run).distinct(), run, "left_semi").withColumn("_up", F.explode(ups)).join(many, [run, "_up"], "left_semi").select(run, path))
    inside = inside.distinct()
    return runs.select(run).distinct().join(inside, run, "left").select(run, F.col(path).isNotNull().alias("scoped"), path)
