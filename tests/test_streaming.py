"""Streams read from files and drained with availableNow."""

from pyspark.sql import functions as F

from loomwork.streaming import feeds


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def source(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_progress_is_deduplicated(spark, tmp_path):
    s = source(spark, tmp_path, [("a", 10), ("b", 11), ("a", 12)], "name string, at long")
    assert sorted(r[0] for r in drained(spark, feeds.progress(s, "name", "at"), "feed")) == ["a", "b"]


def test_triggers(spark, tmp_path):
    rows = [("s", 1, "all done", 10), ("s", 1, "all done", 11), ("s", 2, "done but blocked", 12), ("t", 1, "no", 13)]
    s = source(spark, tmp_path, rows, "session string, turn long, text string, at long")
    got = drained(spark, feeds.turn_triggers(s, r"done", r"blocked"), "triggers")
    assert [r[:2] for r in got] == [("s", 1)]


def test_health(spark, tmp_path):
    rows = [("a", False, 1), ("a", False, 2), ("a", False, 3), ("b", False, 1), ("b", True, 2)]
    s = source(spark, tmp_path, rows, "key string, ok boolean, at long")
    got = {r[0]: r[1:3] for r in drained(spark, feeds.health(s), "health", "update")}
    assert got == {"a": (3, True), "b": (0, False)}
