"""Log files that are still being written, read by byte ranges up to an end that is frozen when the scan is planned.

A Spark data source ``frozen_lines``, for batches and streams. A file's end is the end of its last whole line; what follows is counted and left to the
next scan. A task reads the lines that begin in its range, so each line is read once wherever the ranges are cut. A file that became shorter, or begins with other
bytes than when the scan was planned, was rotated: the scan fails by name and nothing is put together from two files. Files are reached through
pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, day string, node string, start long, line string"
_ARROW = pa.schema([("path", pa.string()), ("day", pa.string()), ("node", pa.string()), ("start", pa.int64()), ("line", pa.string())])
_BLOCK, _TAIL, _HEAD = 4 << 20, 64 << 10, 256


class SourceRotated(Exception):
    """A path isn't the file any more that the scan was planned on."""


@dataclass(frozen=True)
class Frozen:
    """A file up to its last whole line, and what its first bytes were."""

    path: str
    end: int
    head: int
    digest: str
    deferred: int = 0


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    end: int
    #: First bytes and their digest, as every plan that this range rests on has seen them.
    heads: tuple[tuple[int, str], ...]

    def __init__(self, path, start, stop, end, heads):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop, self.end, self.heads = path, start, stop, end, heads


def _files(path: str) -> tuple[arrow_fs.FileSystem, list[arrow_fs.FileInfo]]:
    """Files under a path, by name; hidden ones and those that writers mark are left out."""
    system, at = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    plain = [f for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return system, sorted(plain, key=lambda f: f.path)


def _digest(system: arrow_fs.FileSystem, path: str, n: int) -> str:
    with system.open_input_file(path) as f:
        return hashlib.sha256(f.read(n)).hexdigest()


def freeze(system: arrow_fs.FileSystem, path: str) -> Frozen:
    """The end of the last whole line, searched from the end backwards. A compressed file is taken as it is."""
    with system.open_input_file(path) as f:
        size = f.size()
        end, at = (size, 0) if path.endswith(".gz") else (0, size)
        while at > 0:
            low = max(0, at - _TAIL)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                end = low + cut + 1
                break
            at = low
        f.seek(0)
        head = min(_HEAD, end)
        return Frozen(path, end, head, hashlib.sha256(f.read(head)).hexdigest(), size - end)


def freeze_all(path: str, wanted=None) -> tuple[arrow_fs.FileSystem, list[Frozen]]:
    system, files = _files(path)
    with ThreadPoolExecutor(16) as pool:
        return system, list(pool.map(lambda f: freeze(system, f.path), [f for f in files if wanted is None or wanted(f.path)]))


def labels(path: str) -> tuple[str | None, str | None]:
    """day and node, from folders named day=... and node=..."""
    return tuple(m.group(1) if (m := re.search(rf"/{k}=([^/]+)/", path)) else None for k in ("day", "node"))


def cut(file: Frozen, start: int, size: int, heads: Sequence[tuple[int, str]] = ()) -> list[ByteRange]:
    """Ranges of ``size`` bytes from ``start`` to the frozen end; a compressed file is one."""
    every = (*heads, (file.head, file.digest))
    if file.path.endswith(".gz"):
        return [ByteRange(file.path, start, file.end, file.end, every)] if start < file.end else []
    return [ByteRange(file.path, at, min(at + size, file.end), file.end, every) for at in range(start, file.end, size)]


def _same(system: arrow_fs.FileSystem, part: ByteRange) -> None:
    info = system.get_file_info(part.path)
    if info.type != arrow_fs.FileType.File or info.size < part.end or any(_digest(system, part.path, n) != d for n, d in part.heads):
        raise SourceRotated(part.path)


def _whole_lines(system: arrow_fs.FileSystem, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in the range, with where they begin. A line may end beyond it, up to the frozen end."""
    if part.path.endswith(".gz"):
        at = 0
        with system.open_input_stream(part.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
            for line in f:
                if line.endswith(b"\n"):
                    yield at, line[:-1]
                at += len(line)
        return
    with system.open_input_file(part.path) as f:
        # The range's first line begins behind the first line end from the byte before the range on.
        at, held = max(part.start - 1, 0), b""
        f.seek(at)
        skipping = part.start > 0
        while at < part.end:
            block = f.read(min(_BLOCK, part.end - at))
            if not block:
                return
            data, base = held + block, at - len(held)
            at += len(block)
            low = 0
            while (stop := data.find(b"\n", low)) >= 0:
                if skipping:
                    skipping = False
                elif base + low >= part.stop:
                    return
                else:
                    yield base + low, data[low:stop]
                low = stop + 1
            held = b"" if skipping else data[low:]
            if not skipping and base + low >= part.stop:
                return


def read_range(path: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Batches of the range's lines, blank ones left out. The file is held against its plan before and after."""
    system, _ = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    _same(system, part)
    day, node = labels(part.path)
    starts, lines, held = [], [], 0

    def batch() -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([v] * n, pa.string()) for v in (part.path, day, node)] + [pa.array(starts, pa.int64()), pa.array(lines, pa.string())], schema=_ARROW)

    for at, line in _whole_lines(system, part):
        if line.strip():
            starts.append(at)
            lines.append(line.decode("utf-8", "replace"))
            held += len(line)
        if held > _BLOCK:
            yield batch()
            starts, lines, held = [], [], 0
    yield batch()
    _same(system, part)


class FrozenLines(DataSource):
    """Options: path (a file or folder), range_bytes, and push_filters (true only where spark.sql.python.filterPushdown.enabled is). Columns: path, day, node, start (where the line begins), line."""

    @classmethod
    def name(cls) -> str:
        return "frozen_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _PickingReader if self.options.get("push_filters", "false") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("range_bytes", 64 << 20)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("range_bytes", 64 << 20)))


#: Tasks of a batch scan at most; with more ranges a task reads several in a row.
MOST_TASKS = 256


class ByteRanges(InputPartition):
    """Ranges that one task reads one after the other."""

    def __init__(self, ranges: list[ByteRange]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.wanted: dict[str, set] = {}

    def partitions(self) -> Sequence[InputPartition]:
        def wanted(path: str) -> bool:
            return all(dict(zip(("day", "node"), labels(path)))[k] in v for k, v in self.wanted.items())

        ranges = [r for f in freeze_all(self.path, wanted)[1] for r in cut(f, 0, self.size)]
        if len(ranges) <= MOST_TASKS:
            return ranges
        step = -(-len(ranges) // MOST_TASKS)
        return [ByteRanges(ranges[k : k + step]) for k in range(0, len(ranges), step)]

    def read(self, partition: ByteRange | ByteRanges) -> Iterator[pa.RecordBatch]:
        # Without a file there is one task that has nothing to do.
        if partition is None:
            return
        for r in partition.ranges if isinstance(partition, ByteRanges) else [partition]:
            yield from read_range(self.path, r)


class _PickingReader(_Reader):
    """Spark refuses a reader that takes filters unless the session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with days and nodes picks files; anything else is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("day",), ("node",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """The offset has for each file how far it was read, and what its first bytes were."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({f.path: [f.end, f.head, f.digest] for f in freeze_all(self.path)[1]}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out: list[InputPartition] = []
        for path, (stop, head, digest) in after.items():
            since = before.get(path)
            if since is not None and since[0] > stop:
                raise SourceRotated(path)
            seen = [(since[1], since[2])] if since else []
            if since and path.endswith(".gz") and since[0] < stop:
                raise SourceRotated(path)
            out += cut(Frozen(path, stop, head, digest), since[0] if since else 0, self.size, seen)
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


def frozen_lines(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Lines of the logs under ``path`` as they are when an action plans the scan."""
    spark.dataSource.register(FrozenLines)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("frozen_lines").option("path", path).option("range_bytes", str(range_bytes)).option("push_filters", pushed).load()


def frozen_stream(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream: each micro-batch has the lines that were finished since the one before."""
    spark.dataSource.register(FrozenLines)
    return spark.readStream.format("frozen_lines").option("path", path).option("range_bytes", str(range_bytes)).load()


def deferred_tails(spark: SparkSession, path: str) -> DataFrame:
    """path, end (bytes) and deferred_bytes: what a scan leaves to the next one. One row a file."""
    files = freeze_all(path)[1]
    return spark.createDataFrame([(f.path, f.end, f.deferred) for f in files], "path string, end long, deferred_bytes long")
