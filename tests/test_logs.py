"""Index tables that are replaced whole, logs that are followed as they grow, and batches that are written once."""

import os

import pytest
from pyspark.sql import functions as F

from loomwork.sources import index_table
from loomwork.streaming import logs

SCHEMA = "name string, score long"


def rows(spark, path):
    return sorted((r["name"], r["score"]) for r in index_table.read(spark, path, SCHEMA).collect())


def left_over(folder):
    return [n for n in os.listdir(folder) if n.startswith(".staging")]


def test_a_table_is_read_changed_and_put_back(spark, tmp_path):
    path = str(tmp_path / "index")
    assert rows(spark, path) == []
    assert index_table.upsert(spark, path, spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), "name") is None
    old = index_table.upsert(spark, path, spark.createDataFrame([("b", 3), ("c", 4)], SCHEMA), "name")
    assert rows(spark, path) == [("a", 1), ("b", 3), ("c", 4)] and rows(spark, old) == [("a", 1), ("b", 2)]
    index_table.update(spark, path, SCHEMA, lambda df: df.withColumn("score", F.col("score") * 10))
    assert rows(spark, path) == [("a", 10), ("b", 30), ("c", 40)] and "/.trash/" in old and not left_over(tmp_path)


def test_a_failing_task_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "index")
    index_table.replace(spark.createDataFrame([("a", 1)], SCHEMA), path)
    bad = spark.range(8, numPartitions=4).select(F.lit("x").alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("score"))
    with pytest.raises(Exception, match="no"):
        index_table.replace(bad, path)
    assert rows(spark, path) == [("a", 1)] and not left_over(tmp_path)


def test_a_table_may_not_shrink_too_far(spark, tmp_path):
    path = str(tmp_path / "index")
    index_table.replace(spark.range(20).selectExpr("string(id) AS name", "id AS score"), path)
    with pytest.raises(index_table.ShrinkRefused):
        index_table.update(spark, path, SCHEMA, lambda df: df.filter("score < 9"))
    assert len(rows(spark, path)) == 20 and not left_over(tmp_path)
    index_table.update(spark, path, SCHEMA, lambda df: df.filter("score < 10"))
    index_table.update(spark, path, SCHEMA, lambda df: df.filter("score < 1"), least_share=0.0)
    assert rows(spark, path) == [("0", 0)]


def test_an_old_table_is_brought_under_its_new_name(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    assert index_table.migrated(spark, old, new, SCHEMA) is None
    spark.createDataFrame([("index", "a", 1), ("note", "b", 2), (None, "c", 3)], "_t string, name string, score long").write.json(old)
    assert "/.trash/old-" in index_table.migrated(spark, old, new, SCHEMA)
    assert rows(spark, new) == [("a", 1), ("c", 3)] and not os.path.exists(old)
    assert index_table.migrated(spark, old, new, SCHEMA) is None


def drained(spark, tmp_path, begin="0:0", split=logs.SPLIT_BYTES):
    q = logs.append_once(logs.follow(spark, str(tmp_path / "log"), begin, split), str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "marker")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    if not os.path.isdir(tmp_path / "out"):
        return []
    out = logs.appended(spark, str(tmp_path / "out"), "version long, byte long, line string").collect()
    return [(r["version"], r["line"]) for r in sorted(out, key=lambda r: (r["version"], r["byte"]))]


def test_lines_arrive_once_as_they_are_appended_and_a_new_version_begins_anew(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = tmp_path / "log" / "progress-1.log"
    log.write_text("one\ntwo\nunfinis")
    assert drained(spark, tmp_path, split=3) == [(1, "one"), (1, "two")]
    with log.open("a") as f:
        f.write("hed é\n\nlast\n")
    assert drained(spark, tmp_path, split=3) == [(1, "one"), (1, "two"), (1, "unfinished é"), (1, ""), (1, "last")]
    (tmp_path / "log" / "progress-2.log").write_text("again\n")
    assert drained(spark, tmp_path)[5:] == [(2, "again")]
    assert spark.read.json(str(tmp_path / "marker")).first()["batch"] == 2
    assert len(drained(spark, tmp_path)) == 6


def test_reading_from_a_place(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "progress-4.log").write_text("one\ntwo\nthree\n")
    assert drained(spark, tmp_path, begin="4:4") == [(4, "two"), (4, "three")]


def test_a_batch_tried_again_adds_no_line(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "progress-1.log").write_text("one\ntwo\n")
    first = drained(spark, tmp_path)
    # the driver is lost after the batch was written and before that was noted: its commit is not there
    for f in (tmp_path / "check" / "commits").iterdir():
        f.unlink()
    assert drained(spark, tmp_path) == first == [(1, "one"), (1, "two")]


def test_parts_cut_a_log_at_any_byte(tmp_path):
    text = "".join(f"{'x' * (k % 7)}é{k}\n" for k in range(60)).encode()
    path = tmp_path / "progress-3.log"
    path.write_bytes(text)
    want = [line.decode() for line in text.split(b"\n")[:-1]]
    for split in (1, 2, 5, 50, 10_000):
        parts = [logs._Part(str(path), 3, s, min(s + split, len(text)), len(text)) for s in range(0, len(text), split)]
        assert [line for p in parts for _, _, line in logs._lines(p)] == want
