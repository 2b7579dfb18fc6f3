"""Structured Streaming forms of the progress feed, the session trigger, activity gaps and the health of keyed endpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.classify import completion


def progress(stream: DataFrame, name: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each name once; state for names older than the watermark is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([name])


def turn_triggers(stream: DataFrame, trigger: str, block: str, session: str = "session", turn: str = "turn", at: str = "at", text: str = "text", late: str = "10 minutes") -> DataFrame:
    """The first event of each (session, turn) whose text triggers and isn't blocked; repeats within the watermark are dropped."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([session, turn])
    return once.filter(completion(F.col(text), trigger, block) == "triggered")


def quiet_periods(stream: DataFrame, key: str, at: str, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of activity per key that are followed by a gap: a row is complete once the gap has passed."""
    runs = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(at).alias("last_at"))
    return runs.select(key, F.col("w.start").alias("started_at"), "last_at", "events")


def health(stream: DataFrame, key: str = "key", limit: int = 3, cooldown_ms: int = 0) -> DataFrame:
    """Failures in a row for each key of (key, ok, at), and whether they disable it: from `limit` on, until a success.

    With a cooldown a disabled key counts as usable again that long after its last failure, by the
    events' own times. The state of a key is three numbers, whatever its number of events.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, failed_at, ok_at = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
        for ok, at in zip(rows["_ok"], rows["_at"], strict=True):
            if ok:
                failures, ok_at = 0, int(at)
            else:
                failures, failed_at = failures + 1, int(at)
        state.update((failures, failed_at, ok_at))
        last = int(rows["_at"].max())
        off = failures >= limit and not (cooldown_ms and last - failed_at >= cooldown_ms)
        yield pd.DataFrame([(keys[0], failures, off, failed_at, ok_at)], columns=["key", "failures", "disabled", "last_fail_ms", "last_ok_ms"])

    events = stream.select(F.col(key), F.col("ok").alias("_ok"), F.unix_millis("at").alias("_at"))
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, failures int, disabled boolean, last_fail_ms long, last_ok_ms long", "failures int, failed_at long, ok_at long", "update", GroupStateTimeout.NoTimeout)
