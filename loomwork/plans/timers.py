"""Streams over the events table whose rows come from deadlines as well as from events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..streaming import machines

HOUR = 3_600_000


def _played(spark: SparkSession, sf_dir: str, name: str, machine: machines.Machine, *columns) -> DataFrame:
    """The machine's output for each user over all events, as one trigger: nothing is late, and the watermark ends ten minutes before the last event."""
    schema = tables.read(spark, sf_dir, "events").schema
    # a pattern, for the table may be one file, which a stream doesn't take as its folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "ts", "event_id", "event_type", *columns)
    out = machines.drained(machines.run_machine(stream, machine, "user_id", "ts", "event_id"), name)
    return out.withColumnRenamed("key", "user_id")


def readmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users are disabled after three errors in a row, let in again after six hours without one, or recover."""
    return _played(spark, sf_dir, "readmissions", machines.Readmission(3, 6 * HOUR), (F.col("event_type") != "error").alias("ok"))


def waiting_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How waiting for each user's runs ends, by a result or by the grace or the timeout passing."""
    seen = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "none").otherwise("pending")
    return _played(spark, sf_dir, "waiting", machines.Waiting(6 * HOUR, 18 * HOUR), seen.alias("seen"))


def device_flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of users' authorisations: throttled polls, slower intervals, ends and codes that expire on their own."""
    said = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "slow_down").when(F.col("event_type") == "purchase", "authorized").otherwise("pending")
    return _played(spark, sf_dir, "device", machines.DeviceFlow(2 * HOUR, 72 * HOUR, 2 * HOUR), said.alias("said"))


def settled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of a user's day that nothing follows for two hours; a day that has settled isn't looked at again next."""
    day = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / (24 * HOUR)).cast("string")
    return _played(spark, sf_dir, "settled", machines.Settled(2 * HOUR), day.alias("turn"), F.col("event_type").alias("text"))


def bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users' look-ups get from caches of at most twenty entries that live for ten days."""
    answer = F.when(~F.col("event_type").isin("view", "click"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")))
    name = F.concat(F.lit("k"), (F.floor("value") % 60).cast("string"))
    return _played(spark, sf_dir, "cache", machines.BoundedCache(240 * HOUR), F.col("event_id").alias("ident"), name.alias("name"), answer.alias("answer")).drop("user_id")


QUERIES = {f.__name__: f for f in (readmissions, waiting_ends, device_flow_log, settled_turns, bounded_cache)}

_END = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"

ORACLES = {
    "readmissions": f"""
WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER w AS run, lead(t) OVER w AS nxt, lag(t) OVER w AS prv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS failures FROM r),
p AS (SELECT *, lag(failures) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM f)
SELECT user_id, t AS at_ms, 'disabled' AS standing, failures FROM p WHERE NOT ok AND failures >= 3 AND (failures = 3 OR t - prv >= {6 * HOUR})
UNION ALL SELECT user_id, t + {6 * HOUR}, 'readmitted', failures FROM p WHERE NOT ok AND failures >= 3 AND t + {6 * HOUR} <= coalesce(nxt, {_END})
UNION ALL SELECT user_id, t, 'recovered', 0 FROM p WHERE ok AND before >= 3
""",
    "waiting_ends": f"""
WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'none' ELSE 'pending' END AS s FROM events),
n AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS b, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e),
d AS (SELECT *, CASE s WHEN 'none' THEN greatest(t, b + {6 * HOUR}) WHEN 'pending' THEN greatest(t, b + {18 * HOUR}) ELSE t END AS due FROM n),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM d WHERE s NOT IN ('none', 'pending') OR due = t OR due <= coalesce(nxt, {_END}))
SELECT user_id, due AS at_ms, CASE s WHEN 'pending' THEN 'timeout' ELSE s END AS outcome, due - b AS waited_ms FROM x WHERE k = 1
""",
    "device_flow_log": f"""
WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'slow_down' WHEN 'purchase' THEN 'authorized' ELSE 'pending' END AS a, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
s(user_id, n, t, outcome, iv, nx, ex, live) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM e
  UNION ALL SELECT user_id, n, t, outcome, iv, CASE WHEN a = 'start' OR counts THEN t + iv ELSE nx END, CASE WHEN a = 'start' THEN t + {72 * HOUR} ELSE ex END, a = 'start' OR (lv AND NOT (counts AND a = 'authorized')) FROM (
    SELECT *, CASE WHEN a = 'start' THEN {2 * HOUR} WHEN counts AND a = 'slow_down' THEN iv0 + {2 * HOUR} ELSE iv0 END AS iv, CASE WHEN a = 'start' THEN 'started' WHEN counts THEN a WHEN lv THEN 'throttled' END AS outcome FROM (
      SELECT e.user_id, e.n, e.t, e.a, s.iv AS iv0, s.nx, s.ex, s.live AND e.t < s.ex AS lv, e.a <> 'start' AND s.live AND e.t < s.ex AND e.t >= s.nx AS counts FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))),
l AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM s)
SELECT user_id, t AS at_ms, outcome, iv AS interval_ms FROM l WHERE outcome IS NOT NULL
UNION ALL SELECT user_id, ex, 'expired', iv FROM l WHERE live AND ex <= coalesce(nxt, {_END})
""",
    "settled_turns": f"""
WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, ((epoch_us(ts) // 1000) // {24 * HOUR})::VARCHAR AS turn, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
s(user_id, n, t, last, turn, text, due) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM e
  UNION ALL SELECT user_id, n, t, last, CASE WHEN own IS DISTINCT FROM last THEN own ELSE turn END, CASE WHEN own IS DISTINCT FROM last THEN said ELSE text END, CASE WHEN own IS DISTINCT FROM last THEN t + {2 * HOUR} ELSE due END FROM (
    SELECT e.user_id, e.n, e.t, e.turn AS own, e.text AS said, CASE WHEN s.due <= e.t THEN s.turn ELSE s.last END AS last, CASE WHEN s.due > e.t THEN s.turn END AS turn, CASE WHEN s.due > e.t THEN s.text END AS text, CASE WHEN s.due > e.t THEN s.due END AS due
    FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)),
l AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM s)
SELECT user_id, turn, text, due AS settled_ms FROM l WHERE due <= coalesce(nxt, {_END})
""",
}
