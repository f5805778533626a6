"""The ``rawlog`` data source: assembled records of raw log files, read in byte ranges.

    spark.dataSource.register(RawLog)
    spark.read.format("rawlog").option("agent", "host1").load("/logs/*.log")

Columns: agent, path, offset (bytes, of inflated text for gzip), time, line. A record belongs to the
range that its header line begins in; the task reads on past its range to the record's end, so ranges
need no agreement and nothing is shuffled. Gzip files cannot be cut and are one range each. Comparisons
of ``time`` and substring tests of ``line`` are pushed into the reader, which then skips records before
Spark sees them; an index (option ``index``: a JSON-lines file of path, offset, and the least and most
of timeindex.with_times()) also skips the byte ranges that no record in the time range can lie in.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains
from pyspark.sql.types import StructType

from ..functions.timestamps import timestamp_of

SCHEMA = "agent string, path string, offset bigint, time bigint, line string"
ROWS = 4096


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; ``whole`` files (gzip) are read from their start to their end."""

    path: str
    start: int
    end: int
    whole: bool = False


@dataclass
class Wanted:
    low: int | None = None
    high: int | None = None
    words: list[str] = field(default_factory=list)

    def keeps(self, time: int, line: str) -> bool:
        return (self.low is None or time >= self.low) and (self.high is None or time <= self.high) and all(w in line for w in self.words)


def expand(path: str) -> list[str]:
    found = []
    for p in glob.glob(path):
        if os.path.isdir(p):
            found += [os.path.join(d, n) for d, _, names in os.walk(p) for n in names]
        else:
            found.append(p)
    return sorted(p for p in found if os.path.isfile(p) and not os.path.islink(p))


def numbered_lines(path: str, start: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from the first line that begins at or after ``start``."""
    with (gzip.open(path, "rb") if whole else open(path, "rb")) as f:
        at = 0
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        for line in f:
            yield at, line.removesuffix(b"\n")
            at += len(line)


def records(path: str, start: int, end: int, whole: bool, tz_offset: int) -> Iterator[tuple[int, int, str]]:
    """(offset, time, text) of the records whose header begins in [start, end)."""
    head: tuple[int, int] | None = None
    parts: list[bytes] = []
    for at, line in numbered_lines(path, start, whole):
        time = timestamp_of(line, tz_offset)
        if time is None:
            if head is not None:
                parts.append(line)
            elif at >= end and not whole:
                return
            continue
        if head is not None:
            yield *head, b"\n".join(parts).decode("utf-8", "replace")
        if at >= end and not whole:
            return
        head, parts = (at, time), [line]
    if head is not None:
        yield *head, b"\n".join(parts).decode("utf-8", "replace")


class RawLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.agent, self.path = options.get("agent", ""), options["path"]
        self.tz_offset = int(options.get("tz_offset_seconds", 0))
        self.split = int(options.get("split_bytes", 64 << 20))
        self.index = options.get("index")
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        w = self.wanted
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("time",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                low = f.value + isinstance(f, GreaterThan)
                w.low = low if w.low is None else max(w.low, low)
            if name == ("time",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                high = f.value - isinstance(f, LessThan)
                w.high = high if w.high is None else min(w.high, high)
            taken = name == ("time",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo)
            if name == ("line",) and isinstance(f, StringContains):
                w.words.append(f.value)
                taken = True
            if not taken:
                yield f

    def covered(self, path: str, entries: list[tuple[int, int, int]], size: int) -> list[tuple[int, int]]:
        """The byte ranges of ``path`` that can hold wanted times, from (offset, least, most) entries. The
        part before the first entry has no times, and what follows the last entry can hold any (the file
        may have grown), so only whole segments between entries are skipped."""
        low = self.wanted.low if self.wanted.low is not None else -(1 << 62)
        high = self.wanted.high if self.wanted.high is not None else 1 << 62
        out: list[tuple[int, int]] = []
        for i, (start, least, most) in enumerate(entries, 1):
            end = entries[i][0] if i < len(entries) else size
            if i == len(entries) or least <= high and most >= low:
                joins = out and out[-1][1] == start
                out.append((out.pop()[0] if joins else start, end))
        return out

    def partitions(self) -> list[Range]:
        index: dict[str, list[tuple[int, int, int]]] = {}
        if self.index:
            with open(self.index) as f:
                for row in map(json.loads, f):
                    index.setdefault(row["path"], []).append((row["offset"], row.get("least", -(1 << 62)), row.get("most", 1 << 62)))
        out = []
        for path in expand(self.path):
            size = os.path.getsize(path)
            if path.lower().endswith(".gz"):
                out.append(Range(path, 0, size, True))
                continue
            for start, end in self.covered(path, sorted(index[path]), size) if path in index else [(0, size)]:
                out += [Range(path, at, min(at + self.split, end)) for at in range(start, end, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows: list[tuple[int, int, str]] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([self.agent] * n, pa.string()), pa.array([part.path] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["agent", "path", "offset", "time", "line"])

        for at, time, line in records(part.path, part.start, part.end, part.whole, self.tz_offset):
            if self.wanted.keeps(time, line):
                rows.append((at, time, line))
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


@dataclass
class Tail(InputPartition):
    path: str
    start: int
    end: int


class RawLogStream(DataSourceStreamReader):
    """Tails growing text files line by line. Offsets are {path: [inode, end of the last whole line]}: a
    line without its end is held back, a file with another inode or a smaller size begins anew, and
    files that have gone leave the map. Rows: agent, path, offset, time (of the line, or null), line."""

    def __init__(self, options: dict[str, str]) -> None:
        self.agent, self.path = options.get("agent", ""), options["path"]
        self.tz_offset = int(options.get("tz_offset_seconds", 0))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in expand(self.path):
            st = os.stat(path)
            out[path] = [st.st_ino, whole_lines(path, st.st_size)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Tail]:
        out = []
        for path, (inode, to) in end.items():
            was = start.get(path)
            at = was[1] if was and was[0] == inode and was[1] <= to else 0
            if to > at:
                out.append(Tail(path, at, to))
        return out or [Tail("", 0, 0)]

    def read(self, part: Tail) -> Iterator[tuple]:
        if not part.path:
            return
        for at, line in numbered_lines(part.path, part.start, False):
            if at >= part.end:
                return
            yield self.agent, part.path, at, timestamp_of(line, self.tz_offset), line.decode("utf-8", "replace")


def whole_lines(path: str, size: int, step: int = 1 << 16) -> int:
    """The end of the last ended line within the first ``size`` bytes."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - step)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


class RawLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RawLogReader:
        return RawLogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RawLogStream:
        return RawLogStream(dict(self.options))
