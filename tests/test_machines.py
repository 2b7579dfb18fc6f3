"""Keyed machines: timers go off without further events, and results don't depend on how events are cut into batches."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import timed
from loomwork.plans import timers
from loomwork.streaming import feeds, machines

SCHEMA = {"ok": "boolean", "seen": "string", "said": "string", "turn": "string", "text": "string", "ident": "long", "name": "string", "answer": "string"}


def played(spark, tmp_path, machine, batches, late="0 seconds", key="string"):
    """The machine's rows for batches of (key, at in seconds, what it reads...), one trigger each."""
    schema = f"key {key}, at long, " + ", ".join(f"{c} {SCHEMA[c]}" for c in machine.reads)
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, n) for r in rows], schema + ", n int").withColumn("at", F.timestamp_seconds("at"))
        before = set((tmp_path / "in").glob("*.parquet"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - before:  # files are taken by their time
            os.utime(f, (1_000_000 + 10 * n, 1_000_000 + 10 * n))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = machines.drained(machines.run_machine(stream, machine, "key", "at", late=late), "test")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_a_disabled_key_is_let_in_again_without_a_further_event(spark, tmp_path):
    got = played(spark, tmp_path, machines.Readmission(3, 60_000), [[("a", 1, False), ("a", 2, False)], [("a", 3, False), ("b", 3, False)], [("z", 500, True)]])
    assert got == [("a", 3000, "disabled", 3), ("a", 63000, "readmitted", 3)]


def test_waiting_ends_by_a_result_the_grace_or_the_timeout(spark, tmp_path):
    batches = [[("done", 10, "pending"), ("none", 10, "none"), ("slow", 10, "pending")], [("done", 30, "success"), ("slow", 40, "pending"), ("done", 35, "failure")], [("z", 110, "success")]]
    got = played(spark, tmp_path, machines.Waiting(10_000, 60_000), batches, late="50 seconds")
    # the watermark ends at 60: the timeout at 70 is still to come
    assert got == [("done", 30000, "success", 20000), ("none", 20000, "none", 10000), ("z", 110000, "success", 0)]


def test_a_timeout_passes_without_a_further_event(spark, tmp_path):
    got = played(spark, tmp_path, machines.Waiting(10_000, 60_000), [[("slow", 10, "pending")], [("z", 110, "success")]])
    assert got == [("slow", 70000, "timeout", 60000), ("z", 110000, "success", 0)]


def test_device_codes_expire_and_early_polls_are_throttled(spark, tmp_path):
    flow = [("f", 10, "start"), ("f", 12, "pending"), ("f", 16, "slow_down"), ("f", 22, "pending"), ("f", 26, "authorized")]
    rest = [("g", 10, "start"), ("g", 15, "pending"), ("h", 10, "start"), ("h", 17, "denied"), ("h", 40, "pending"), ("q", 13, "pending")]
    got = played(spark, tmp_path, machines.DeviceFlow(5000, 60_000, 5000), [flow[:3], [*flow[3:], *rest], [("z", 310, "pending")]], late="1 hour")
    assert [g[1:] for g in got if g[0] == "f"] == [(10000, "started", 5000), (12000, "throttled", 5000), (16000, "slow_down", 10000), (22000, "throttled", 10000), (26000, "authorized", 10000)]
    assert [g[2] for g in got if g[0] == "h"] == ["started", "denied"] and not [g for g in got if g[0] == "q"]
    (tmp_path / "more").mkdir()
    got = played(spark, tmp_path / "more", machines.DeviceFlow(5000, 60_000, 5000), [[("g", 10, "start")], [("z", 310, "pending")]])
    assert got == [("g", 10000, "started", 5000), ("g", 70000, "expired", 5000)]


def test_a_turn_is_looked_at_once_it_has_settled(spark, tmp_path):
    batches = [[("s", 1, "1", "a"), ("s", 3, "1", "b")], [("s", 40, "1", "again"), ("s", 50, "2", "c"), ("t", 50, None, "d")], [("z", 500, "1", "e")]]
    got = played(spark, tmp_path, machines.Settled(10_000), batches)
    assert got == [("s", "1", "b", 13000), ("s", "2", "c", 60000), ("t", None, "d", 60000)]


def plain_cache(rows, ttl, most=20, evict=10):
    caches, out = {}, []
    for key, at, ident, name, answer in sorted(rows, key=lambda r: r[1]):
        c = caches.setdefault(key, {})
        for n in [n for n, (t, _) in c.items() if at * 1000 - t > ttl]:
            del c[n]
        if answer is None:
            out.append((key, ident, name, c[name][1] if name in c else None, len(c)))
        else:
            c[name] = (at * 1000, answer)
            if len(c) > most:
                for n in list(c)[:evict]:
                    del c[n]
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_a_cache_forgets_and_never_grows_beyond_its_bound(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), t, t, f"k{rng.randrange(40)}", rng.choice([None, f"v{t}", f"w{t}"])) for t in range(1, 401)]
    step = len(rows) // cuts
    got = played(spark, tmp_path, machines.BoundedCache(90_000), [rows[k : k + step] for k in range(0, len(rows), step)], late="1 hour")
    assert got == plain_cache(rows, 90_000) and max(g[4] for g in got) <= 20


def test_a_cache_of_one_name_answers_as_the_batch_form_does(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), t * 7, t, "own", rng.choice([None, None, "x", "y"])) for t in range(1, 121)]
    got = {g[1]: g[3] for g in played(spark, tmp_path, machines.BoundedCache(30_000 - 1), [rows[:50], rows[50:]], late="1 hour")}
    df = spark.createDataFrame(rows, "key string, at long, ident long, name string, answer string").withColumn("at", F.timestamp_seconds("at"))
    want = {r["ident"]: r["answer"] for r in timed.cached(df, "key", "at", "answer", 30, "ident").collect()}
    assert got == {i: want[i] for i in got}


def test_the_query_over_caches_is_the_plain_one(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["view", "click", "error", "signup", "purchase"]
    rows = [(t, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=3 * t), rng.randrange(2), rng.choice(kinds), rng.uniform(0, 150), "{}") for t in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(((r["ident"], r["name"], r["answer"], r["size"]) for r in timers.bounded_cache(spark, str(tmp_path)).collect()), key=str)
    plain = [(u, 3 * 3600 * t, t, f"k{int(v) % 60}", None if k in ("view", "click") else f"{k}-{t}") for t, _, u, k, v, _ in rows]
    assert got == sorted((r[1:] for r in plain_cache(plain, 240 * 3_600_000)), key=str)


def test_null_keys_and_times_take_no_part(spark, tmp_path):
    got = played(spark, tmp_path, machines.Readmission(1, 1000), [[(None, 1, False), ("a", None, False), ("a", 5, False), ("a", 5, False)]], late="1 hour")
    assert got == [("a", 5000, "disabled", 1)]


def test_quiet_periods(spark, tmp_path):
    rows = [("a", 1), ("a", 10), ("a", 100), ("b", 5), ("z", 5000)]
    df = spark.createDataFrame(rows, "key string, at long").withColumn("at", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = machines.drained(feeds.quiet_periods(stream, "key", "at", late="0 seconds"), "quiet").collect()
    assert sorted((r["key"], r["events"], int(r["last_at"].replace(tzinfo=datetime.UTC).timestamp()) if r["last_at"].tzinfo is None else 0) for r in out if r["key"] != "z") == [("a", 1, 100), ("a", 2, 10), ("b", 1, 5)]
