"""Growing log files as a stream: a Spark streaming data source that follows files through rotation.

``path`` is a file or a pattern of files on a disk that the driver and all executors mount. A file is known by its
inode, and an offset holds for each file how far it was read. A batch takes what is new up to the last line end, so that a
half-written line waits; a line that goes on for LINE_BYTES without end is given in pieces of that size, wherever
batches end; a line end right behind a full piece is an empty line. Batches are planned by byte ranges in the checkpoint: after a restart the same lines are read again for a
batch that did not end, and none twice or not at all for those that did.

* Renamed (rotated) files are read to their last line end under their new name, as long as they stay in the folder; the
  new file at the old name is read from its start. A rest without line end is left out.
* A file that shrank, or whose first bytes are others, was written anew and is read from its start.
* A file that is gone before a planned batch has read it fails the batch, as lines would be lost.

``from_start=false`` begins behind what the files hold when the stream first starts.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file string, place long, line string"
LINE_BYTES, BATCH_BYTES, HEAD_BYTES = 1 << 20, 64 << 20, 128


@dataclass
class Range(InputPartition):
    path: str
    file: str
    low: int
    high: int


def _head(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


def _stop(path: str, low: int, high: int) -> int:
    """Where the whole lines of a range end: behind its last line end, and behind the full pieces of an endless line."""
    with open(path, "rb") as f:
        at = high
        while at > low:
            start = max(low, at - LINE_BYTES)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                at = start + found + 1
                break
            at = start
    return at + (high - at) // LINE_BYTES * LINE_BYTES


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, line) of bytes that end with a line end or a full piece."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at, at + LINE_BYTES)
        if end < 0:
            yield at, data[at : at + LINE_BYTES]
            at += LINE_BYTES
        else:
            yield at, data[at:end]
            at = end + 1


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        if "://" in self.path:
            raise ValueError("logs are followed on mounted disks only")
        self.most, self.from_start = int(options.get("batch_bytes", BATCH_BYTES)), options.get("from_start", "true").lower() == "true"
        self.seen: dict = {}

    def _files(self) -> dict[str, str]:
        """Inode and path of the files at the watched names and, for those read before, of others in their folders."""
        watched = {p for p in glob.glob(self.path) if os.path.isfile(p)}
        near = {e.path for folder in {os.path.dirname(p) or "." for p in [self.path, *watched]} if os.path.isdir(folder) for e in os.scandir(folder) if e.is_file()}
        inode = lambda p: str(os.stat(p).st_ino)
        return {i: p for p in near - watched if (i := inode(p)) in self.seen} | {inode(p): p for p in watched}

    def initialOffset(self) -> dict:
        return {} if self.from_start else {i: self._read_to(p, os.stat(p).st_size, 0) for i, p in self._files().items()}

    @staticmethod
    def _read_to(path: str, at: int, times: int) -> dict:
        n = min(at, HEAD_BYTES)
        return {"at": at, "head": [n, _head(path, n)], "times": times}

    def latestOffset(self) -> dict:
        out = dict(self.seen)
        for inode, path in self._files().items():
            size, now = os.stat(path).st_size, self.seen.get(inode, {"at": 0, "head": [0, 0], "times": 0})
            n, crc = now["head"]
            if size < now["at"] or _head(path, n) != crc:
                now = {"at": 0, "times": now["times"] + 1}
            out[inode] = self._read_to(path, _stop(path, now["at"], min(size, now["at"] + self.most)), now["times"])
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = {**end, **self.seen}
        paths = self._files()
        ranges = []
        for inode, now in sorted(end.items()):
            before = start.get(inode, {"at": 0, "times": 0})
            low = before["at"] if before["times"] == now["times"] else 0
            if now["at"] > low:
                if inode not in paths:
                    raise RuntimeError(f"file {inode} is gone before it was read from {low} to {now['at']}")
                ranges.append(Range(paths[inode], inode, low, now["at"]))
        return ranges

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        path = part.path
        if not os.path.exists(path) or str(os.stat(path).st_ino) != part.file:  # renamed since it was planned
            path = next((e.path for e in os.scandir(os.path.dirname(path) or ".") if e.is_file() and str(e.stat().st_ino) == part.file), path)
        with open(path, "rb") as f:
            f.seek(part.low)
            data = f.read(part.high - part.low)
        if len(data) < part.high - part.low:
            raise RuntimeError(f"{path} lost bytes before it was read from {part.low} to {part.high}")
        names, rows = ["path", "file", "place", "line"], []
        for place, line in pieces(data):
            rows.append((part.path, part.file, part.low + place, line.decode("utf-8", errors="replace")))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def commit(self, end: dict) -> None:
        # Files that are gone for good are forgotten with the next offset.
        there = self._files()
        self.seen = {i: x for i, x in self.seen.items() if i in there}


class Logs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def log_lines(spark: SparkSession, path: str, from_start: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A stream of (path, file, place, line); a file is read at most ``batch_bytes`` a batch."""
    spark.dataSource.register(Logs)
    return spark.readStream.format("growing_logs").option("path", path).option("from_start", str(from_start)).option("batch_bytes", batch_bytes).load()
