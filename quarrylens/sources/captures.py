"""Captures as a Spark data source: classic and next-generation files in planned partitions, and a sink for classic ones.

A large file is cut at every ``partition_bytes``. A partition begins LEAD bytes early and follows the headers from there as far
as its own range. In a classic capture a chain from a false place may pass the end of its record and never meet the true one:
both sizes of a record are alike, so headers that are read four bytes late follow each other as well. All places within one
largest record are therefore followed, of which one is true. Blocks of next-generation files have their length at both ends, so
the first chain that holds is taken. A record belongs to the partition in which it begins, so all records are read once.

For files of more than one partition a first scan, in the same partitions, lists what goes with the second: of classic files the few
chains that run through a partition, with their first places and where they leave it, of which those that follow each other from the
start of the file are true; of next-generation files all sections and interfaces, as packets name an interface of their section.
Units of time are those of each interface. Behind a damaged record, where no list leads, a partition finds its first record by itself:
it is the one place to which all chains lead, if need be from twice as far, in the end from the start of the file.

``frame_no`` is the place of the record in its file, so it is unique there and grows along the file. Reading of a partition ends
at a damaged record; later partitions go on from their own first record. Files of other formats have no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quarrylens.sources.packets import MAGIC, NAMES, SCHEMA, _batch, packet

LAYOUT = "path string, place long, link int, tick double, leaves long"
LAYOUT_NAMES, LAYOUT_KINDS = [c.split()[0] for c in LAYOUT.split(", ")], [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
FRAMES = "ts double, frame binary"
PARTITION_BYTES, LEAD, WINDOW = 64 << 20, 1 << 20, 4 << 20
# Block types and bounds of records.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
SECTION_MARK, MOST_FRAME, MOST_BLOCK = b"\x0a\x0d\x0d\x0a", 262_144, 1 << 24
ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
#: Stands for the start of a section in a layout.
NEW_SECTION = -1


class Window:
    """Bytes of a file anywhere, read a few megabytes at a time."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.low, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place`` on, fewer at the end."""
        if place < self.low or place + n > self.low + len(self.held):
            self.low, self.held = place, self.file.read_at(max(n, min(WINDOW, max(self.size - place, 0))), place) if place < self.size else b""
        return self.held[place - self.low : place - self.low + n]


class Classic:
    """Records of 16 bytes and a frame behind a header of 24."""

    first, step, shifts = 24, 1, (12, 8, 4)

    def __init__(self, view: Window):
        head = view.at(0, 24)
        self.view, (self.order, self.unit) = view, MAGIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0] & 0xFFFF
        self.head = struct.Struct(self.order + "4I")

    def after(self, place: int) -> int | None:
        """Where the next record begins, None if none is here."""
        raw = self.view.at(place, 16)
        if len(raw) < 16:
            return None
        _, fraction, size, _ = self.head.unpack(raw)
        if not 0 < size <= MOST_FRAME or fraction >= self.unit or place + 16 + size > self.view.size:
            return None
        return place + 16 + size

    def plausible(self, begin: int, n: int) -> Iterator[tuple[int, int]]:
        """Those of ``n`` places from ``begin`` on where a record may begin, in order, and where the next one would."""
        raw = np.frombuffer(self.view.at(begin, n + 15), np.uint8)
        number = np.ndarray(max(len(raw) - 3, 0), self.order + "u4", raw, strides=(1,)).astype(np.uint32)
        size = number[8:][:n]
        at = np.flatnonzero((number[4:][: len(size)] < int(self.unit)) & (size - np.uint32(1) < MOST_FRAME))  # 0 - 1 is the largest number
        after = begin + at + 16 + size[at].astype(np.int64)
        ok = after <= self.view.size
        return zip((begin + at)[ok].tolist(), after[ok].tolist(), strict=True)

    def frame(self, place: int, end: int) -> tuple[float, int, bytes]:
        seconds, fraction, size, _ = self.head.unpack(self.view.at(place, 16))
        return seconds + fraction / self.unit, self.link, self.view.at(place + 16, size)


class NextGeneration:
    """Blocks with their length at both ends; sections set the byte order, interfaces the link and the unit of time."""

    first, step, shifts = 0, 4, ()

    def __init__(self, view: Window, layout: list[tuple[int, int, float]]):
        self.view, self.layout = view, layout
        self.places = [p for p, _, _ in layout]
        self.order = ORDER.get(view.at(8, 4), "<")

    def _length(self, place: int, order: str) -> int | None:
        raw = self.view.at(place + 4, 4)
        if len(raw) < 4:
            return None
        size = struct.unpack(order + "I", raw)[0]
        if not 12 <= size <= MOST_BLOCK or size % 4 or place + size > self.view.size:
            return None
        return size if self.view.at(place + size - 4, 4) == raw else None

    def after(self, place: int) -> int | None:
        if self.view.at(place, 4) == SECTION_MARK and (order := ORDER.get(self.view.at(place + 8, 4))):
            self.order = order
        size = self._length(place, self.order)
        if size is None:  # in a search the order of the section may be the other one
            other = "<" if self.order == ">" else ">"
            size = self._length(place, other)
            if size is not None:
                self.order = other
        return None if size is None else place + size

    def described(self, place: int, end: int) -> tuple[int, int, float] | None:
        """(place, link, tick) of a section or an interface."""
        kind = self.view.at(place, 4)
        if kind == SECTION_MARK:
            return place, NEW_SECTION, 0.0
        if struct.unpack(self.order + "I", kind)[0] != INTERFACE:
            return None
        body = self.view.at(place + 8, end - place - 12)
        if len(body) < 8:
            return place, 0, 1e-6
        at, tick = 8, 1e-6
        while at + 4 <= len(body):
            code, n = struct.unpack_from(self.order + "HH", body, at)
            if code == 0 or at + 4 + n > len(body):
                break
            if code == 9 and n:
                tick = float(2 if body[at + 4] & 0x80 else 10) ** -(body[at + 4] & 0x7F)
                break
            at += 4 + (n + 3) // 4 * 4
        return place, struct.unpack_from(self.order + "H", body)[0], tick

    def _interface(self, place: int, number: int) -> tuple[int, float]:
        last = bisect_right(self.places, place)
        first = max((i + 1 for i in range(last) if self.layout[i][1] == NEW_SECTION), default=0)
        return self.layout[first + number][1:] if first + number < last else (0, 1e-6)

    def frame(self, place: int, end: int) -> tuple[float, int, bytes] | None:
        kind = struct.unpack(self.order + "I", self.view.at(place, 4))[0]
        body = self.view.at(place + 8, end - place - 12) if kind in (ENHANCED, SIMPLE) else b""
        if kind == ENHANCED and len(body) >= 20:
            number, high, low, size, _ = struct.unpack_from(self.order + "5I", body)
            link, tick = self._interface(place, number)
            return (((high << 32) | low) * tick, link, body[20 : 20 + size]) if size <= min(MOST_FRAME, len(body) - 20) else None
        if kind == SIMPLE and 4 <= len(body) <= MOST_FRAME + 4:
            return 0.0, self._interface(place, 0)[0], body[4:]
        return None


@dataclass
class Part(InputPartition):
    path: str
    low: int
    high: int


def _reached(form: Classic, begin: int, low: int) -> set[int]:
    """Where the chains come to at ``low`` from all places of a stretch that holds a record's start, or from the first record."""
    known = begin <= form.first
    reached, own = ({form.first}, form.first) if known else (set(), begin + MOST_FRAME + 16)
    for at in range(form.first if known else begin, low, LEAD):
        end = min(at + LEAD, low)
        for place, after in form.plausible(at, end - at):
            if place in reached or place < own:
                reached.add(after)
        reached = {place for place in reached if place >= end}
    return reached


def _meeting(form: Classic, low: int) -> int | None:
    """The one place to which the chains lead at ``low``."""
    lead = LEAD
    while (begin := low - lead) > form.first:
        places = _reached(form, begin, low)
        if len(places) < 2:
            return next(iter(places), None)
        lead *= 2
    return None


def _chains(form: Classic, low: int, high: int) -> list[tuple[int, int]]:
    """Where the chains begin that may hold the records from ``low`` to ``high``, and where they leave; -1 if they end before."""
    now = {place: place for place in _reached(form, low - LEAD, low) if place < high}
    for at in range(low, high, LEAD):
        after = dict(form.plausible(at, min(LEAD, high - at)))
        for first, place in now.items():
            while place in after:
                place = after[place]
            now[first] = place
    return [(first, place if place >= high else -1) for first, place in sorted(now.items())]


def _starts(leaves: dict[int, int]) -> list[int]:
    """The first record of each partition, by chains that follow each other from the first record of a file."""
    starts, place = [], Classic.first
    while place in leaves:
        starts.append(place)
        place = leaves[place]
    return starts


def first_record(form: Classic | NextGeneration, low: int) -> int | None:
    """The first record that begins at ``low`` or later."""

    def walk(place: int) -> int | None:
        while place < low:
            place = form.after(place)
            if place is None:
                return None
        return place

    def follows(place: int, records: int = 64) -> bool:
        """Whether so many records follow each other from here on, or all up to the end of the file.

        Both sizes of a record are alike, so headers that are read four bytes late may follow each other as well; then
        the earlier reading is the true one.
        """
        while records and place < form.view.size:
            last, records = place, records - 1
            place = form.after(place)
            if place is None:  # what a capture ends with may be cut off
                return last + MOST_FRAME >= form.view.size and records < 60
        return True

    if low <= form.first:
        return form.first
    if isinstance(form, Classic) and (found := _meeting(form, low) or walk(form.first)) is not None:
        return found
    # Next-generation files, and classic ones that are damaged before ``low``.
    begin = low - LEAD
    if begin > form.first:
        begin -= (begin - form.first) % form.step
        for place in range(begin, low - LEAD // 2, form.step):
            if (found := walk(place)) is not None:
                return next((walk(found - n) for n in form.shifts if found - n >= form.first and follows(found - n)), found)
    return walk(form.first)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _form(view: Window, layout: list[tuple[int, int, float]]) -> Classic | NextGeneration | None:
    head = view.at(0, 24)
    if head[:4] in MAGIC and len(head) == 24:
        return Classic(view)
    return NextGeneration(view, layout) if head[:4] == SECTION_MARK and head[8:12] in ORDER else None


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.only_layout = options.get("rows") == "layout"
        self.layout = {p: [tuple(x) for x in rows] for p, rows in json.loads(options.get("layout", "{}")).items()}
        self.starts = json.loads(options.get("starts", "{}"))

    def partitions(self) -> list[Part]:
        system, path = _system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        sized = [(f.path, f.size) for f in files if not self.only_layout or f.size > self.step]
        return [Part(p, low, min(size, low + self.step)) for p, size in sorted(sized) for low in range(0, size, self.step)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        view = Window(_system(self.path)[0], part.path)
        layout = list(self.layout.get(part.path, []))
        form = _form(view, layout)
        if form is None:
            return
        told = lambda rows: pa.RecordBatch.from_pylist([dict(zip(LAYOUT_NAMES, r, strict=True)) for r in rows], pa.schema(list(zip(LAYOUT_NAMES, LAYOUT_KINDS, strict=True))))
        if self.only_layout and isinstance(form, Classic):
            yield told([(part.path, first, None, None, leaves) for first, leaves in _chains(form, part.low, part.high)])
            return
        starts = self.starts.get(part.path, [])
        known = bisect_left(starts, part.low)
        rows, place = [], starts[known] if known < len(starts) else first_record(form, part.low)
        while place is not None and place < part.high and (end := form.after(place)) is not None:
            own = form.described(place, end) if isinstance(form, NextGeneration) and (self.only_layout or part.path not in self.layout) else None
            if own and self.only_layout:
                rows.append((part.path, *own, None))
            elif own:
                form.layout.append(own)
                form.places.append(place)
            elif not self.only_layout and (found := form.frame(place, end)):
                ts, link, frame = found
                if fields := packet(link, frame):
                    rows.append((part.path, place, ts, *fields))
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
            place = end
        if self.only_layout:
            yield told(rows)
        elif rows:
            yield _batch(rows)


@dataclass
class Written(WriterCommitMessage):
    path: str


class CaptureWriter(DataSourceArrowWriter):
    """A classic capture a task, with times in microseconds; files of tasks that failed are removed."""

    def __init__(self, options: dict):
        self.path, self.link = options["path"], int(options.get("link", 1))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.pcap"
        with system.open_output_stream(name) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MOST_FRAME, self.link))
            for batch in batches:
                told = []
                for ts, frame in zip(batch.column("ts").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                    micros = round((ts or 0.0) * 1e6)
                    if frame:
                        told += struct.pack("<4I", micros // 1_000_000 & 0xFFFFFFFF, micros % 1_000_000, len(frame), len(frame)), frame
                out.write(b"".join(told))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                _system(self.path)[0].delete_file(m.path)


class Captures(DataSource):
    """``spark.read.format("captures").option("path", ...)``; ``read_captures`` also lists large files' interfaces first."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return LAYOUT if self.options.get("rows") == "layout" else SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options)


def read_captures(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row an IP packet of all captures under ``path`` (a file or a folder, on any file system that Arrow opens)."""
    spark.dataSource.register(Captures)
    reader = lambda: spark.read.format("captures").option("path", path).option("partition_bytes", partition_bytes)
    layout: dict[str, list] = {}
    leaves: dict[str, dict[int, int]] = {}
    # One row a section or interface, or a chain and partition, of files larger than a partition, not of packets.
    for r in sorted(reader().option("rows", "layout").load().collect(), key=lambda r: (r["path"], r["place"])):
        if r["leaves"] is None:
            layout.setdefault(r["path"], []).append((r["place"], r["link"], r["tick"]))
        else:
            leaves.setdefault(r["path"], {})[r["place"]] = r["leaves"]
    starts = {file: _starts(chains) for file, chains in leaves.items()}
    return reader().option("layout", json.dumps(layout)).option("starts", json.dumps(starts)).load()


def write_captures(frames: DataFrame, path: str, link: int = 1) -> None:
    """Write ``frames(ts, frame)`` as classic captures of one link type."""
    frames.sparkSession.dataSource.register(Captures)
    frames.select("ts", "frame").write.format("captures").option("path", path).option("link", link).mode("append").save()
