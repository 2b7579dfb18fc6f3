"""Operators over what happens in time: caches with expiry, waiting with a grace, authorisation flows, replay steps, and reports of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy


def cached(rows: DataFrame, key: str, at: str, answer: str, ttl_seconds: int, ident: str, unknown: str = "unknown") -> DataFrame:
    """ident and the answer that a cache gives each row: the last one learned before it, while that isn't older than the time to live. Unknown answers aren't kept."""
    known = F.when(F.col(answer) != unknown, F.struct(F.col(answer).alias("answer"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")))
    before = Window.partitionBy(key).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.select(ident, F.unix_micros(F.col(at).cast("timestamp")).alias("_now"), F.last(known, ignorenulls=True).over(before).alias("_k"))
    return last.select(ident, F.when(F.col("_now") - F.col("_k.at") < ttl_seconds * 1_000_000, F.col("_k.answer")).alias("answer"))


def wait_outcome(polls: DataFrame, key: str, elapsed: str, seen: str, grace: int, timeout: int, tie: str) -> DataFrame:
    """key, outcome and elapsed of the first poll of each key that ends the waiting; null while none does.

    A result ends it, no runs (none) from the grace on, and pending ones (pending) from the timeout on.
    """
    ends = F.when(F.col(seen) == "none", F.when(F.col(elapsed) >= grace, "none")).when(F.col(seen) != "pending", F.col(seen)).when(F.col(elapsed) >= timeout, "timeout")
    first = F.min_by(F.struct(ends.alias("outcome"), F.col(elapsed).alias("elapsed")), F.when(ends.isNotNull(), F.struct(elapsed, tie)))
    return polls.groupBy(key).agg(first.alias("_o")).select(key, "_o.outcome", "_o.elapsed")


def device_state(answers: DataFrame, key: str, order: list[str], answer: str, base_ms: int, step_ms: int, final: tuple[str, ...] = ("authorized", "denied", "expired")) -> DataFrame:
    """key, status, answers and interval_ms of each flow: the first final answer ends it, each slow_down before lengthens the interval."""
    w = Window.partitionBy(key).orderBy(*order)
    ended = F.max(F.when(F.col(answer).isin(*final), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = answers.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0")
    slow = F.count_if(F.col(answer) == "slow_down")
    status = F.coalesce(F.max(F.when(F.col(answer).isin(*final), F.col(answer))), F.lit("pending"))
    return live.groupBy(key).agg(status.alias("status"), F.count(F.lit(1)).alias("answers"), policy.poll_interval_ms(slow, F.lit(base_ms), step_ms).alias("interval_ms"))


def steps_after(rows: DataFrame, chain: str, sha: str, size: str, resume: Column) -> DataFrame:
    """chain, sha, step and what each step adds to the one before it, for the steps after the resume point."""
    w = Window.partitionBy(chain).orderBy(sha)
    added = F.round(F.col(size) - F.coalesce(F.lag(size).over(w), F.lit(0)), 2)
    return rows.select(chain, sha, F.row_number().over(w).cast("long").alias("step"), added.alias("added")).filter(F.col(sha) > resume)


_NOT_CODE = r"""(?s)//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""


def stripped(source: Column) -> Column:
    """A source text without comments and with empty strings."""
    return F.regexp_replace(source, _NOT_CODE, "")


# Statements that call the network.
_NETWORK = r"await\s+(?:fetch|https?\.request)\s*\(|createServer\s*\(|\.listen\s*\(|net\.connect\s*\("


def calls_network(source: Column) -> Column:
    return F.coalesce(stripped(source).rlike(_NETWORK), F.lit(False))


def severity_report(findings: DataFrame, by: str, files: int, samples: int, chars: int = 80) -> DataFrame:
    """Of each group the findings by severity and in all, how many block, in how many files, the first files and findings.

    Files and findings are ranked before they are gathered, so that no group is held whole.
    """
    counts = findings.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("blocker", "error", "warning", "notice")], F.count(F.lit(1)).alias("total"))
    blocking = findings.filter(policy.blocks(F.col("severity"))).select(by, "file", "line", F.left("message", F.lit(chars)).alias("message"))
    totals = blocking.groupBy(by).agg(F.count(F.lit(1)).alias("blocked"), F.countDistinct("file").alias("files"))
    place = lambda *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    names = blocking.select(by, "file").distinct().withColumn("_n", place("file")).filter(F.col("_n") <= files)
    names = names.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("first_files"))
    shown = blocking.withColumn("_n", place("file", "line", "message")).filter(F.col("_n") <= samples)
    text = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.length("message").cast("string"))
    shown = shown.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))), lambda x: x["t"]), ",").alias("samples"))
    out = counts.join(totals, by, "left").join(names, by, "left").join(shown, by, "left")
    return out.select(*counts.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocked", "files")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("first_files", "samples")])
