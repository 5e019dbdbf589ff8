"""Streaming source over growing text files (A-25).

spark.dataSource.register(TailTextSource)
spark.readStream.format("tail_text").option("path", folder).load()  ->  (file, offset, value)

The stream's position is {file: {"offset": bytes consumed, "inode": n}}. A file that shrank or was
replaced is read again from its start. A line counts only once its newline is there. A file that is away for
a while keeps its position; one that goes while it is read gives what could be read. All files are
followed, unless maxFiles asks for the first so many by name. A batch takes all that is new: a source of this kind
does not learn where the stream stands before it has to name the batch's end.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from opslens.session import ship

ship(__name__)

SPLIT_BYTES = 64 * 1024 * 1024
PROBE_BYTES = 64 * 1024
BATCH_LINES = 10_000


class FileRange(InputPartition):
    """The lines of a file that start in [start, stop)."""

    def __init__(self, path: str, start: int, stop: int, end: int, first: bool):
        self.path, self.start, self.stop, self.end, self.first = path, start, stop, end, first


def complete_bytes(path: str, size: int) -> int:
    """Bytes up to and including the last newline among the first `size` bytes."""
    with open(path, "rb") as fh:
        end = size
        while end > 0:
            begin = max(0, end - PROBE_BYTES)
            fh.seek(begin)
            at = fh.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def _number(options: dict, name: str) -> int | None:
    """A limit as asked for; without one there is none."""
    given = options.get(name.lower(), options.get(name))
    if given is not None and int(given) < 1:
        raise ValueError(f"{name} must be at least 1")
    return None if given is None else int(given)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("glob", "*.txt")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.max_files = _number(options, "maxFiles")
        self.seen: dict = {}  # positions of all files met so far, those that are away included
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def _files(self) -> list[str]:
        found = []
        for folder, _, names in os.walk(self.path):
            found += [os.path.join(folder, n) for n in names if fnmatch.fnmatch(n, self.glob)]
            if not self.recursive:
                break
        return sorted(found)[: self.max_files]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.seen)
        for path in self._files():
            try:
                info = os.stat(path)
                out[path] = {"offset": complete_bytes(path, info.st_size), "inode": info.st_ino}
            except FileNotFoundError:  # gone since it was listed
                continue
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        self.seen = {**start, **end, **self.seen}  # after a restart the start is all that is known
        ranges = []
        for path, now in end.items():
            seen = start.get(path, {"offset": 0, "inode": now["inode"]})
            begin = seen["offset"]
            if seen["inode"] != now["inode"] or now["offset"] < begin:
                begin = 0
            for low in range(begin, now["offset"], self.split_bytes):
                high = min(low + self.split_bytes, now["offset"])
                ranges.append(FileRange(path, low, high, now["offset"], low == begin))
        return ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        try:
            fh = open(partition.path, "rb")
        except FileNotFoundError:
            return
        with fh:
            if partition.first:
                fh.seek(partition.start)
            else:
                # the line running into this range belongs to the range before
                fh.seek(partition.start - 1)
                fh.readline()
            at = fh.tell()
            offsets: list[int] = []
            values: list[str] = []

            def batch() -> pa.RecordBatch:
                columns = [pa.array([partition.path] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(values)]
                return pa.record_batch(columns, names=["file", "offset", "value"])

            while at < partition.stop:
                line = fh.readline(partition.end - at)
                if not line:
                    break
                text = line.rstrip(b"\r\n").decode("utf-8", errors="ignore")
                if text.strip():
                    offsets.append(at)
                    values.append(text)
                at += len(line)
                if len(values) >= BATCH_LINES:
                    yield batch()
                    offsets, values = [], []
            if values:
                yield batch()


class TailTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_text"

    def schema(self) -> str:
        return "file string, offset bigint, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
