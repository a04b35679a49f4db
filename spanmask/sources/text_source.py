"""S1 as a Spark data source: lines of text files, undecodable bytes as U+FFFD.

    spark.dataSource.register(TextLines)
    spark.read.format("spanmask_text").option("path", folder).load()        # path, offset, text
    spark.readStream.format("spanmask_text").option("path", folder).load()

Files are read in splits of ``splitSize`` bytes (32 MB); a line belongs to the split in which it
begins, and its reader goes on beyond the split to its end, so no character is cut: a line feed
is no part of a longer UTF-8 sequence, and what is repaired in a line does not depend on
its neighbours.  ``offset`` is the byte at which a line starts.  Lines end with a line feed; the
last one may lack it, in a stream it waits for it.

A stream's offset is the number of bytes read of each file, always between lines; files may grow
and new ones appear.  Files are opened through ``pyarrow.fs`` by every executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, text string"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("text", pa.string())])
_BLOCK, _ROWS = 1 << 20, 10_000


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the file or of the folder's files; files and folders whose names begin with
    . or _ are skipped."""
    system, path = _open(uri)
    info = system.get_file_info(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    shown = (f for f in found if f.is_file and (info.is_file or not re.search(r"(^|/)[._]", f.path[len(path) :])))
    return sorted((prefix + f.path, f.size) for f in shown)


def _lines(split: Split) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin in the split."""
    system, path = _open(split.path)
    with system.open_input_file(path) as f:
        # the byte before the split tells whether a line begins with it
        at = max(split.start - 1, 0)
        f.seek(at)
        rest, first = b"", split.start > 0
        while True:
            block = f.read(_BLOCK)
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if not first:
                    if at >= split.end:
                        return
                    yield at, line
                first = False
                at += len(line) + 1
            if not block:
                if rest and not first and at < split.end:
                    yield at, rest
                return
            if at >= split.end and not first:
                return


def _batches(split: Split) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, str]] = []
    for offset, line in _lines(split):
        rows.append((split.path, offset, line.decode("utf-8", errors="replace")))
        if len(rows) >= _ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _splits(path: str, start: int, end: int, size: int) -> list[Split]:
    return [Split(path, a, min(a + size, end)) for a in range(start, end, size)]


class _Reader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def partitions(self) -> list[Split]:
        return [s for path, n in _files(self.uri) for s in _splits(path, 0, n, self.size)] or [Split("", 0, 0)]

    def read(self, partition: Split):
        if partition.path:
            yield from _batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({path: n for path, size in _files(self.uri) if (n := _whole_lines(path, size))})}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [s for path, n in sorted(now.items()) for s in _splits(path, before.get(path, 0), n, self.size)] or [Split("", 0, 0)]

    def read(self, partition: Split):
        if partition.path:
            yield from _batches(partition)

    def commit(self, end: dict) -> None:
        pass


def _whole_lines(path: str, size: int) -> int:
    """Bytes of a file up to its last line feed."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        end = size
        while end > 0:
            start = max(0, end - _BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class TextLines(DataSource):
    """The data source ``spanmask_text``; options ``path`` and ``splitSize``."""

    @classmethod
    def name(cls) -> str:
        return "spanmask_text"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        path, size = self.options.get("path"), int(self.options.get("splitSize", 32 << 20))
        if not path or size < 1:
            raise ValueError("spanmask_text needs a path, and a splitSize of one byte or more")
        return path, size

    def reader(self, schema) -> _Reader:
        return _Reader(*self._options())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(*self._options())
