"""A growing log as a data source of its own, for batches and streams: lines with their file and place in it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "observation_log"
LINES = "file string, at long, value string"
#: Bytes of a partition, about: it ends with the line in which they end.
PART = 32 << 20
_BLOCK = 1 << 20


class Part(InputPartition):
    """The lines of a file that begin at or after `begin` and before `end`."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The folder's visible files, in order of their names, or the file itself."""
    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = files.get_file_info(at)
    found = [info] if info.is_file else [x for x in files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.is_file]
    return files, sorted((x for x in found if x.base_name[0] not in "._"), key=lambda x: x.path)


def _parts(files: fs.FileSystem, begun: dict[str, int], ended: dict[str, int]) -> list[Part]:
    return [Part(f, b, min(b + PART, end)) for f, end in sorted(ended.items()) for b in range(begun.get(f, 0), end, PART)]


def whole_lines(files: fs.FileSystem, file: str, size: int, least: int) -> int:
    """Where the last whole line of a file ends, not before `least`: a line that is still being written waits."""
    end = size
    with files.open_input_file(file) as source:
        while end > least:
            begin = max(least, end - _BLOCK)
            source.seek(begin)
            if (found := source.read(end - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return least


def read_lines(files: fs.FileSystem, part: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the part; the last may end behind it. A block is held at a time, and a line."""
    with files.open_input_file(part.file) as source:
        at = max(0, part.begin - 1)  # if the byte before ends a line, one begins here
        source.seek(at)
        rest, skipping = b"", part.begin > 0
        while True:
            block = source.read(_BLOCK)
            rest += block
            begin = 0
            while (end := rest.find(b"\n", begin)) >= 0:
                if skipping:
                    skipping = False
                elif at + begin < part.end:
                    yield at + begin, rest[begin:end]
                else:
                    return
                begin = end + 1
            at, rest = at + begin, rest[begin:]
            if not block:
                if rest and not skipping and at < part.end:
                    yield at, rest
                return
            if not skipping and at >= part.end:
                return


class _Reading:
    def __init__(self, path: str):
        self.path = path

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), "")
        rows: list[tuple[int, str]] = []
        for at, line in read_lines(files, part):
            rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            if len(rows) == 1000:
                yield self._batch(part, rows)
                rows = []
        if rows:
            yield self._batch(part, rows)

    @staticmethod
    def _batch(part: Part, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([x for _, x in rows])], ["file", "at", "value"])


class _BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        files, found = _files(self.path)
        return _parts(files, {}, {x.path: x.size for x in found})


class _StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the bytes of each file that have been read, up to the end of a line."""

    def __init__(self, path: str):
        super().__init__(path)
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        files, found = _files(self.path)
        self.ends = {x.path: whole_lines(files, x.path, x.size, min(x.size, self.ends.get(x.path, 0))) for x in found}
        return {"ends": json.dumps(self.ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files, _ = _files(self.path)
        return _parts(files, json.loads(start["ends"]), json.loads(end["ends"]))

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offset."""


class ObservationLog(DataSource):
    """LINES of a text log (a file, or a folder's files), read in parallel pieces of about 32 MB.

    A line's place is the byte at which it begins, so (file, at) orders lines however a log is cut into pieces. A batch
    reads all there is; a stream what has come since, by whole lines, also at the end of files that grow. Files are
    reached through Arrow's file systems (local, HDFS, object stores).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObservationLog)
