"""Keyed state machines with deadlines: each gets a key's events in time order and is woken by a timer when nothing else comes.

A machine is a state, what an event does to it, when it falls due, and what happens then. Deadlines
that pass before an event are met before it, in the same batch or not, so results depend on the
events' times alone and not on how they are cut into batches. What is left is a timer of the state
store: it goes off once the watermark has passed it, without a further event of the key.

Events have the columns key, at (timestamp) and those that a machine names; rows of one key and one
trigger are sorted in memory, so a trigger's size (maxFilesPerTrigger, maxBytesPerTrigger) bounds it.
Null keys and null times take no part.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.shared import folder

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """Subclasses name their fields of state, their columns and their output, and say what happens."""

    fields = ""  # of the state, as a schema
    reads: tuple[str, ...] = ()  # columns of events
    gives = ""  # output behind the key, as a schema

    def begin(self) -> dict:
        raise NotImplementedError

    def on_event(self, s: dict, e) -> list[tuple]:
        raise NotImplementedError

    def due(self, s: dict) -> int | None:
        raise NotImplementedError

    def on_due(self, s: dict, at: int) -> list[tuple]:
        raise NotImplementedError

    def over(self, s: dict) -> bool:
        """Whether the state can go: a new one behaves alike."""
        return False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._names = handle, [f.split()[0] for f in self.fields.split(", ")]
        self._value = handle.getValueState("machine", self.fields)

    def _loaded(self) -> dict:
        kept = self._value.get() if self._value.exists() else None
        return self.begin() if kept is None else dict(zip(self._names, kept, strict=True))

    def _kept(self, s: dict, before: int | None) -> None:
        if self.over(s):
            self._value.clear()
            after = None
        else:
            self._value.update(tuple(s[n] for n in self._names))
            after = self.due(s)
        if before is not None and before != after:
            self._handle.deleteTimer(before)
        if after is not None and before != after:
            self._handle.registerTimer(after)

    def _met(self, s: dict, now: int) -> list[tuple]:
        out = []
        while (due := self.due(s)) is not None and due <= now:
            out += self.on_due(s, due)
        return out

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        names = ["key", *(f.split()[0] for f in self.gives.split(", "))]
        yield pd.DataFrame([(key[0], *o) for o in out], columns=names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["at_", "tie_"], kind="stable")
        s, out = self._loaded(), []
        before = self.due(s)
        for e in events.itertuples(index=False, name="Event"):
            out += self._met(s, e[0])
            out += self.on_event(s, e[0], *e[2:])
        self._kept(s, before)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, gone = self._loaded(), expiredTimerInfo.getExpiryTimeInMs()
        before = self.due(s)
        # what else is due by now has no timer of its own yet
        out = self._met(s, max(gone, timerValues.getCurrentWatermarkInMs()))
        self._kept(s, None if before == gone else before)  # the store has taken the timer out
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


class Settled(Machine):
    """The last event of a turn once nothing has followed for settle_ms: (turn, text, settled_ms).

    A turn that was looked at last is not looked at again; a newer event starts the wait anew.
    """

    fields, reads = "last string, turn string, text string, due long", ("turn", "text")
    gives = "turn string, text string, settled_ms long"

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def begin(self):
        return {"last": None, "turn": None, "text": None, "due": None}

    def on_event(self, s, at, turn, text):
        turn = None if turn is None else str(turn)
        if turn != s["last"] or s["last"] is None:
            s.update(turn=turn, text=text, due=at + self.settle_ms)
        return []

    def due(self, s):
        return s["due"]

    def on_due(self, s, at):
        out = [(s["turn"], s["text"], at)]
        s.update(last=s["turn"], turn=None, text=None, due=None)
        return out


class Readmission(Machine):
    """Changes of a key's standing: disabled by limit failures in a row, readmitted cooldown_ms after the last one, recovered by a success."""

    fields, reads = "failures long, failed_at long, off boolean", ("ok",)
    gives = "at_ms long, standing string, failures long"

    def __init__(self, limit: int, cooldown_ms: int):
        self.limit, self.cooldown_ms = limit, cooldown_ms

    def begin(self):
        return {"failures": 0, "failed_at": 0, "off": False}

    def on_event(self, s, at, ok):
        if ok:
            was = s["failures"] >= self.limit
            s.update(failures=0, failed_at=0, off=False)
            return [(at, "recovered", 0)] if was else []
        s.update(failures=s["failures"] + 1, failed_at=at)
        if s["failures"] >= self.limit and not s["off"]:
            s["off"] = True
            return [(at, "disabled", s["failures"])]
        return []

    def due(self, s):
        return s["failed_at"] + self.cooldown_ms if s["off"] else None

    def on_due(self, s, at):
        s["off"] = False
        return [(at, "readmitted", s["failures"])]

    def over(self, s):
        return s["failures"] == 0


class Waiting(Machine):
    """How waiting for a key's results ends: by a result, with none grace_ms after the first event while nothing runs, or by timeout_ms while something does."""

    fields, reads = "begun long, seen string, ended boolean", ("seen",)
    gives = "at_ms long, outcome string, waited_ms long"

    def __init__(self, grace_ms: int, timeout_ms: int):
        self.grace_ms, self.timeout_ms = grace_ms, timeout_ms

    def begin(self):
        return {"begun": None, "seen": None, "ended": False}

    def on_event(self, s, at, seen):
        if s["ended"]:
            return []
        if s["begun"] is None:
            s["begun"] = at
        s["seen"] = seen
        if seen not in ("none", "pending"):
            s["ended"] = True
            return [(at, seen, at - s["begun"])]
        due = self.due(s)
        return self.on_due(s, at) if due <= at else []  # nothing runs any more, and the grace is long over

    def due(self, s):
        if s["ended"] or s["begun"] is None:
            return None
        return s["begun"] + (self.grace_ms if s["seen"] == "none" else self.timeout_ms)

    def on_due(self, s, at):
        s["ended"] = True
        return [(at, "none" if s["seen"] == "none" else "timeout", at - s["begun"])]


class DeviceFlow(Machine):
    """An authorisation by code: (at_ms, outcome, interval_ms) for each answer that counts, and for its end.

    An event is a start, or the answer of a poll. Polls before the next one is allowed are throttled
    and change nothing; slow_down lengthens the interval; the code expires on its own. A start
    begins anew, whatever came before. Polls without a start and after the end are ignored.
    """

    fields, reads = "status string, interval long, next long, expires long", ("said",)
    gives = "at_ms long, outcome string, interval_ms long"

    def __init__(self, interval_ms: int, expires_ms: int, step_ms: int = 5000):
        self.interval_ms, self.expires_ms, self.step_ms = interval_ms, expires_ms, step_ms

    def begin(self):
        return {"status": "idle", "interval": 0, "next": 0, "expires": 0}

    def on_event(self, s, at, said):
        if said == "start":
            s.update(status="waiting", interval=self.interval_ms, next=at + self.interval_ms, expires=at + self.expires_ms)
            return [(at, "started", s["interval"])]
        if s["status"] != "waiting":
            return []
        if at < s["next"]:
            return [(at, "throttled", s["interval"])]
        if said == "slow_down":
            s["interval"] += self.step_ms
        if said not in ("slow_down", "pending"):
            s["status"] = said
        s["next"] = at + s["interval"]
        return [(at, said, s["interval"])]

    def due(self, s):
        return s["expires"] if s["status"] == "waiting" else None

    def on_due(self, s, at):
        s["status"] = "expired"
        return [(at, "expired", s["interval"])]

    def over(self, s):
        return s["status"] == "idle"


class BoundedCache(Machine):
    """Answers from a cache of its key's entries that expire and never are more than most: (ident, name, answer, size) for each look-up.

    An event with an answer stores it under its name, at the place that the name has already; beyond
    most entries the evict ones stored first go. One without asks, and gets null from a cache that
    doesn't know, or no longer. Entries leave once they are older than ttl_ms, by a timer if need be.
    """

    fields, reads = "names array<string>, ats array<long>, answers array<string>", ("ident", "name", "answer")
    gives = "ident long, name string, answer string, size int"

    def __init__(self, ttl_ms: int, most: int = 20, evict: int = 10):
        self.ttl_ms, self.most, self.evict = ttl_ms, most, evict

    def begin(self):
        return {"names": [], "ats": [], "answers": []}

    def _loaded(self):
        return {k: list(v) for k, v in super()._loaded().items()}

    def on_event(self, s, at, ident, name, answer):
        known = s["names"].index(name) if name in s["names"] else -1
        if answer is None:
            return [(ident, name, s["answers"][known] if known >= 0 else None, len(s["names"]))]
        if known >= 0:
            s["ats"][known], s["answers"][known] = at, answer
        else:
            for column, x in zip(("names", "ats", "answers"), (name, at, answer), strict=True):
                s[column].append(x)
        if len(s["names"]) > self.most:
            for column in s:
                del s[column][: self.evict]
        return []

    def due(self, s):
        return min(s["ats"]) + self.ttl_ms + 1 if s["ats"] else None

    def on_due(self, s, at):
        live = [k for k, x in enumerate(s["ats"]) if x + self.ttl_ms >= at]
        for column in s:
            s[column] = [s[column][k] for k in live]
        return []

    def over(self, s):
        return not s["names"]


def run_machine(events: DataFrame, machine: Machine, key: str, at: str = "at", tie: str | None = None, late: str = "10 minutes", processing_time: bool = False) -> DataFrame:
    """The machine's output over a stream of events, for each key. Equal times go by the column tie.

    Timers go by event time: one goes off when the watermark, late behind the newest event, has
    passed it. With processing_time they go by the clock, and events count as happening as they come.
    """
    kind, time = events.schema[key].dataType.simpleString(), F.col(at).cast("timestamp")
    read = [F.unix_millis(time).alias("at_"), (F.col(tie) if tie else F.lit(0)).alias("tie_"), *[F.col(c) for c in machine.reads]]
    usable = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    if processing_time:
        usable = usable.select(F.col(key).alias("key"), *read)
    else:
        usable = usable.select(F.col(key).alias("key"), time.alias("time_"), *read).withWatermark("time_", late)
    return usable.groupBy("key").transformWithStateInPandas(_Ordered(machine), f"key {kind}, {machine.gives}", "Append", "ProcessingTime" if processing_time else "EventTime")


class _Ordered(StatefulProcessor):
    """Hands a machine the columns that it names, in their order."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle):
        self.machine.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        names = ["at_", "tie_", *self.machine.reads]
        now = timerValues.getCurrentProcessingTimeInMs()
        plain = (_objects(r[names], now if "time_" not in r.columns else None) for r in rows)
        yield from self.machine.handleInputRows(key, plain, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.machine.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self):
        pass


def _objects(rows: pd.DataFrame, now: int | None) -> pd.DataFrame:
    """Plain Python values, None for null; events of the clock happen now."""
    out = rows.astype(object).where(rows.notna(), None)
    if now is not None:
        out["at_"] = now
    return out


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Timers need the RocksDB state store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet in the shared folder, and reads that."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
