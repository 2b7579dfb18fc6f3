"""Stage chains: named DataFrame-to-DataFrame steps in order, with a receipt of what each changed."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import pinned
from . import diff

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Stage:
    """on_fail: block ends the chain, warn notes the error and skip drops it; either goes on with the stage's input."""

    name: str
    step: Callable[[DataFrame], DataFrame]
    on_fail: str = "block"


def snapshot(df: DataFrame, key: str) -> DataFrame:
    """path and sig of each row: the key as text, and a fingerprint of all columns."""
    return df.select(F.col(key).cast("string").alias("path"), F.left(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256), F.lit(16)).alias("sig"))


def run(df: DataFrame, stages: list[Stage], key: str) -> tuple[DataFrame, DataFrame]:
    """The last stage's rows, and one receipt a stage: ord, stage, status, and rows added, modified and deleted.

    What went wrong in a stage that doesn't end the chain is logged. Each stage's rows are pinned once, so that neither receipts nor later stages run it again.
    """
    spark, receipts, now = df.sparkSession, [], pinned(df)
    for n, stage in enumerate(stages):
        try:
            after, status = pinned(stage.step(now)), "ok"
        except Exception as error:
            if stage.on_fail == "block":
                raise
            log.warning("stage %s: %s: %s", stage.name, type(error).__name__, error)
            after, status = now, "failed" if stage.on_fail == "warn" else "skipped"
        changes = diff.change_counts(diff.snapshot_changes(snapshot(now, key), snapshot(after, key)))
        receipts.append(changes.select(F.lit(n).alias("ord"), F.lit(stage.name).alias("stage"), F.lit(status).alias("status"), "added", "modified", "deleted", "total"))
        now = after
    out = receipts[0] if receipts else spark.createDataFrame([], "ord int, stage string, status string, added long, modified long, deleted long, total long")
    for r in receipts[1:]:
        out = out.unionByName(r)
    return now, out
