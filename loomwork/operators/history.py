"""What a path held over the steps of a chain of snapshots, as intervals; any step's changes are then a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Entries of snapshots that one task sorts, by parts_for().
ROWS_A_TASK = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts to deal so many rows to: as many as the session has for shuffles, and more where a task would have over ROWS_A_TASK."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def _dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    return df.repartition(parts, *by) if parts else df


def intervals(steps: DataFrame, entries: DataFrame, chain: str, step: str, path: str, state: list[str], parts: int | None = None) -> DataFrame:
    """chain, path, the state columns, first and last: the places, from 1, between which a path held one state without a gap.

    steps has each step of each chain, whether it holds anything or not; entries the paths that a step
    holds. Places are given to the steps of a chain in order, and only (chain, path) meet in one
    place after that. Entries of steps that aren't known are left out; of several entries of a path
    at one step the least counts. parts, if given, is how many tasks each of the sorts is dealt to.
    """
    numbered = _dealt(steps.select(chain, step), parts, chain).distinct().withColumn("_at", F.row_number().over(Window.partitionBy(chain).orderBy(step)))
    held = _dealt(entries, parts, chain, step).groupBy(chain, step, path).agg(F.min(F.struct(*state)).alias("_s"))
    held = _dealt(held.join(_dealt(numbered, parts, chain, step), [chain, step]), parts, chain)
    w = Window.partitionBy(chain, path).orderBy("_at")
    goes_on = (F.lag("_at").over(w) == F.col("_at") - 1) & F.lag("_s").over(w).eqNullSafe(F.col("_s"))
    runs = held.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy(chain, path, "_run").agg(F.first("_s").alias("_s"), F.min("_at").cast("long").alias("first"), F.max("_at").cast("long").alias("last"))
    return out.select(chain, path, *[F.col("_s").getField(c).alias(c) for c in state], "first", "last")


def changes(spans: DataFrame, chain: str, path: str, state: list[str], last_step: DataFrame) -> DataFrame:
    """chain, step (its place), path, change (added, changed, removed) and the state from then on, for all steps of all chains.

    last_step (chain, steps) says how long chains are: what ends with its chain is not removed.
    """
    w = Window.partitionBy(chain, path).orderBy("first")
    named = spans.withColumn("_before", F.lag("last").over(w)).withColumn("_next", F.lead("first").over(w))
    begun = named.select(chain, F.col("first").alias("step"), path, F.when(F.col("_before") == F.col("first") - 1, "changed").otherwise("added").alias("change"), *state)
    ended = named.join(last_step, chain).filter((F.col("last") < F.col("steps")) & ~F.coalesce(F.col("_next") == F.col("last") + 1, F.lit(False)))
    none = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in state]
    return begun.unionByName(ended.select(chain, (F.col("last") + 1).alias("step"), path, F.lit("removed").alias("change"), *none))


def tree_at(spans: DataFrame, place: Column) -> DataFrame:
    """The spans that hold at a place: the snapshot of that step."""
    return spans.filter((F.col("first") <= place) & (place <= F.col("last")))


def resume_place(steps: DataFrame, markers: DataFrame, chain: str, step: str, parts: int | None = None) -> DataFrame:
    """chain and done: the place of the step up to which a chain is replayed by its marker (chain, step); 0 without one, or if it isn't on the chain."""
    steps = _dealt(steps.select(chain, step), parts, chain)
    numbered = steps.distinct().withColumn("_at", F.row_number().over(Window.partitionBy(chain).orderBy(step)).cast("long"))
    met = markers.join(_dealt(numbered, parts, chain, step), [chain, step]).groupBy(chain).agg(F.max("_at").alias("_done"))
    return steps.select(chain).distinct().join(met, chain, "left").select(chain, F.coalesce("_done", F.lit(0)).alias("done"))
