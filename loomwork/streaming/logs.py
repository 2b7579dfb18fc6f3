"""Append-only logs: lines as they are appended, read from any place on, and written once however often a batch is tried.

A log is a folder of versions, progress-<version>.log, each of them only ever appended to. Readers
follow the newest version; a new one begins from its first line, and what hadn't been read of the
older ones is left behind, as for a client whose version isn't the server's any more.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = re.compile(r"progress-(\d+)\.log$")
#: Bytes of one task of a batch.
SPLIT_BYTES = 16_000_000


class _Part(InputPartition):
    def __init__(self, path: str, version: int, start: int, stop: int, whole: int):
        self.path, self.version, self.start, self.stop, self.whole = path, version, start, stop, whole


def _lines(part: _Part) -> Iterator[tuple]:
    """(version, byte, line) of the lines that begin in a part; the last one may end behind it, at most at whole."""
    with open(part.path, "rb") as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())  # the rest of a line that began before, or its line feed alone
        while at < part.stop:
            f.seek(at)
            line = f.readline(part.whole - at)
            yield part.version, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class LogReader(DataSourceStreamReader):
    """Offsets are a version and the bytes of its complete lines. The option from, version:byte, says where a first batch begins."""

    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        version, _, byte = options.get("from", "0:0").partition(":")
        self.begin = {"version": int(version), "bytes": int(byte or 0)}

    def initialOffset(self) -> dict:
        return self.begin

    def _newest(self) -> int:
        found = [int(m[1]) for n in os.listdir(self.folder) if (m := NAME.search(n))] if os.path.isdir(self.folder) else []
        return max(found, default=0)

    def latestOffset(self) -> dict:
        version = self._newest()
        path = f"{self.folder}/progress-{version}.log"
        if not os.path.exists(path):
            return self.begin
        # back from the end to the last line feed
        end = os.path.getsize(path)
        with open(path, "rb") as f:
            while end:
                start = max(0, end - 65536)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return {"version": version, "bytes": start + at + 1}
                end = start
        return {"version": version, "bytes": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first = start["bytes"] if start["version"] == end["version"] else 0
        path = f"{self.folder}/progress-{end['version']}.log"
        stops = range(first, end["bytes"], self.split)
        return [_Part(path, end["version"], s, min(s + self.split, end["bytes"]), end["bytes"]) for s in stops]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _lines(partition)


class LogSource(DataSource):
    """spark.readStream.format("progress_log"): version, byte and line of appended lines, of a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "progress_log"

    def schema(self) -> str:
        return "version long, byte long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def follow(spark: SparkSession, folder: str, begin: str = "0:0", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The stream of a log's lines from version:byte on."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("progress_log").option("from", begin).option("splitBytes", split_bytes).load(folder)


def append_once(stream: DataFrame, folder: str, checkpoint: str, marker: str | None = None):
    """A writer, to be started, that puts each batch's rows into batch=<id> of a folder of JSON lines.

    A batch that is tried again, after a failure or on another driver, overwrites its own folder, so no
    line comes twice. If given, the table marker gets one row, the batch done last: what a later step may
    resume behind.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{folder}/batch={batch}")
        if marker:
            rows.sparkSession.range(1).selectExpr(f"{batch}L AS batch").coalesce(1).write.mode("overwrite").json(marker)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def appended(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What append_once has written, with its batch."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", folder).json(f"{folder}/batch=*")
