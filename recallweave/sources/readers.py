"""Data sources of Spark: `folder_walk`, the files below a folder, and `separated_records`, records of growing files, as a batch or a stream.

Both read any file system that Arrow can name by an URI (or a plain path, which driver and executors must share), in tasks of bounded
size. Bytes that are no UTF-8 are never replaced: text is null and `valid` false, or the read fails where the option `mode` is `failfast`. After
`register(spark)`:

    spark.read.format("folder_walk").load(folder)
    spark.readStream.format("separated_records").option("separator", "␟").load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import labels

FILES = "path string, modified bigint, size bigint, text string, valid boolean"
RECORDS = "path string, position bigint, record string, valid boolean"
#: Rows and bytes of a batch that a task hands over.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    system, inner = arrow_fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/") or "/"


def _entries(system: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    """What a folder holds and a walk may enter, by name: nothing hidden, none of the skipped folders."""
    found = sorted(system.get_file_info(arrow_fs.FileSelector(folder, recursive=False)), key=lambda f: f.base_name)
    return [f for f in found if not f.base_name.startswith(".") and not (f.type == arrow_fs.FileType.Directory and f.base_name in labels.WALK_SKIP_DIRS)]


def _text(data: bytes, strict: bool, where: str) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        if strict:
            raise ValueError(f"{where} is no UTF-8") from None
        return None


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


_FILES = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64()), ("text", pa.string()), ("valid", pa.bool_())])
_RECORDS = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record", pa.string()), ("valid", pa.bool_())])


@dataclass
class Walk(InputPartition):
    """Files to read and folders to walk, each with the depth that is left below it."""

    files: tuple[str, ...] = ()
    folders: tuple[tuple[str, int], ...] = ()


class FolderWalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.depth = options["path"], int(options.get("depth", 10))
        self.wanted, self.many, self.strict = int(options.get("folders", 64)), int(options.get("files", 1000)), options.get("mode") == "failfast"

    def partitions(self) -> list[InputPartition]:
        """The driver opens folders level by level until there are `folders` of them, which tasks then walk; files it meets go in groups of `files`."""
        system, root = _opened(self.root)
        open_, files = [(root, self.depth)], []
        if system.get_file_info(root).type != arrow_fs.FileType.Directory:
            raise FileNotFoundError(self.root)
        while 0 < len(open_) < self.wanted:
            deeper = []
            for folder, depth in open_:
                for f in _entries(system, folder):
                    if f.type == arrow_fs.FileType.Directory:
                        deeper += [(f.path, depth - 1)] if depth > 1 else []
                    elif f.type == arrow_fs.FileType.File:
                        files.append(f.path)
            open_ = deeper
        groups = [Walk(files=tuple(files[i : i + self.many])) for i in range(0, len(files), self.many)]
        return groups + [Walk(folders=(f,)) for f in open_] or [Walk()]

    def _files(self, system: arrow_fs.FileSystem, part: Walk) -> Iterator[arrow_fs.FileInfo]:
        for i in range(0, len(part.files), 100):
            yield from (f for f in system.get_file_info(list(part.files[i : i + 100])) if f.type == arrow_fs.FileType.File)
        left = list(part.folders)
        while left:
            folder, depth = left.pop()
            for f in _entries(system, folder):
                if f.type == arrow_fs.FileType.File:
                    yield f
                elif f.type == arrow_fs.FileType.Directory and depth > 1:
                    left.append((f.path, depth - 1))

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)

        def rows() -> Iterator[tuple]:
            for f in self._files(system, partition):
                try:
                    with system.open_input_stream(f.path, compression=None) as stream:
                        data = stream.read()
                except FileNotFoundError:
                    continue  # gone since it was listed
                text = _text(data, self.strict, f.path)
                yield f.path, (f.mtime_ns or 0) // 1_000_000_000, f.size, text, text is not None

        return _batches(rows(), _FILES, lambda r: r[2])


class FolderWalk(DataSource):
    """path, modified (s), size, text, valid of the files at most `depth` levels below a folder; hidden ones and the skipped folders are not entered.
    Which files to admit is left to `labels.should_index`. A file that goes while the walk runs isn't there, one that is empty has an empty text."""

    @classmethod
    def name(cls) -> str:
        return "folder_walk"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return FolderWalkReader(dict(self.options))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    stop: int  # where the file ends for this read


class Records:
    """What batch and stream share: ranges of files, and the records that begin in a range."""

    def __init__(self, options: dict[str, str]):
        self.root, self.bytes, self.strict = options["path"], int(options.get("split_bytes", 64 << 20)), options.get("mode") == "failfast"
        self.sep = options.get("separator", "\n").encode()
        if not self.sep or self.bytes < 1:
            raise ValueError("separator and split_bytes can't be empty")

    def sizes(self) -> dict[str, int]:
        system, root = _opened(self.root)
        found = system.get_file_info(root)
        if found.type == arrow_fs.FileType.File:
            return {found.path: found.size}
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        return {f.path: f.size for f in _entries(system, root) if f.type == arrow_fs.FileType.File and not f.base_name.startswith("_")}

    def ranges(self, path: str, start: int, stop: int) -> list[Range]:
        return [Range(path, at, min(at + self.bytes, stop), stop) for at in range(start, stop, self.bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        return _batches(self._records(system, partition), _RECORDS, lambda r: len(r[2] or ""))

    def _records(self, system: arrow_fs.FileSystem, part: Range, block: int = 1 << 20) -> Iterator[tuple]:
        """Records whose first byte lies in the range; the last may end behind it. A record begins at 0 or behind a separator."""
        if part.end <= part.start:
            return
        with system.open_input_file(part.path) as file:
            begin = max(0, part.start - len(self.sep))
            file.seek(begin)
            held, at, scan, inside = bytearray(), begin, 0, part.start == 0
            while True:
                data = file.read(min(block, part.stop - at - len(held)))
                held += data
                while True:
                    cut = held.find(self.sep, scan)
                    if cut < 0:
                        scan = max(0, len(held) - len(self.sep) + 1)
                        break
                    if inside:
                        yield self._row(part.path, at, bytes(held[:cut]))
                    del held[: cut + len(self.sep)]
                    at, scan, inside = at + cut + len(self.sep), 0, True
                    if at >= part.end:
                        return
                if not data:
                    break
                if not inside and at + scan >= part.end:
                    return  # no record begins here
            if inside and held:
                yield self._row(part.path, at, bytes(held))

    def _row(self, path: str, at: int, data: bytes) -> tuple:
        text = _text(data, self.strict, f"the record at {at} of {path}")
        return path, at, text, text is not None


class RecordsReader(Records, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [r for path, size in sorted(self.sizes().items()) for r in self.ranges(path, 0, size)] or [Range("", 0, 0, 0)]


class RecordsStreamReader(Records, DataSourceStreamReader):
    """Offsets are the bytes that were read of each file. Only records that a separator ends are read, so one that is being written waits. Files
    grow by appending; one that has gone or shrunk is left as it was."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _opened(self.root)
        return {path: self._whole(system, path, size) for path, size in self.sizes().items()}

    def _whole(self, system: arrow_fs.FileSystem, path: str, size: int, block: int = 1 << 16) -> int:
        """Where the last separator ends, read from behind."""
        with system.open_input_file(path) as file:
            end = size
            while end > 0:
                start = max(0, end - block)
                file.seek(start)
                cut = file.read(min(size, end + len(self.sep) - 1) - start).rfind(self.sep)
                if cut >= 0:
                    return start + cut + len(self.sep)
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for path in sorted(end) for r in self.ranges(path, start.get(path, 0), end[path])]

    def commit(self, end: dict) -> None:
        pass


class SeparatedRecords(DataSource):
    """path, position (bytes), record, valid of a file's or a flat folder's records, between separators. What follows the last separator is a record of
    a batch where it isn't empty; empty records before it stay. A range of `split_bytes` is a task, so one large file is read by many."""

    @classmethod
    def name(cls) -> str:
        return "separated_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return RecordsReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordsStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (FolderWalk, SeparatedRecords):
        spark.dataSource.register(source)
