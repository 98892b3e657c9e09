"""Lines of growing files, each once: a Python data source for streams and for batches.

A stream's offset holds a cursor for each file: how far whole lines go, the file's size, digests of its head, and the parser's
version. A batch reads what lies between two cursors; a last line without its end waits. A file starts over where it shrank, its
head changed, or the parser's version rose; then its first line (at 0) comes again. What a batch reads follows from
its two offsets alone, so a batch that is done again after a failure reads the same ranges.

Heads are digests of the first HEADS bytes, doubling, as far as the file goes: the longest that two cursors share tells whether the file
is still the same, without reading it. Ranges are cut into splits, and a line belongs to the split in which it begins. Files are
reached through pyarrow's file systems, so a path may name any store that executors can open. The driver holds one
cursor a file, and reads the head and the end of those that changed; lines never pass through it.
"""

import hashlib
import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Prefixes of a file whose digests tell it apart.
HEADS = [1 << k for k in range(6, 13)]
SPLIT_BYTES = 64 << 20
#: Bytes that are read at once, and lines of a batch of rows.
BLOCK, ROWS = 1 << 20, 4096
#: A longer line is skipped.
MOST_BYTES = 256 << 20
SCHEMA = "file string, at long, value string"
ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])


def opened(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def same_file(old: dict, new: dict) -> bool:
    """Whether new goes on from old; cursors have at, size, heads and pv."""
    if old["pv"] != new["pv"] or new["size"] < old["size"] or new["at"] < old["at"]:
        return False
    a, b = (x["heads"].split(",") if x["heads"] else [] for x in (old, new))
    n = min(len(a), len(b))
    return not n or a[n - 1] == b[n - 1]


def ranges(start: dict, end: dict, split: int) -> Iterator[tuple[str, int, int, int]]:
    """(file, from, to, whole range's end) of what end has and start hasn't."""
    for file, text in sorted(end.items()):
        new = json.loads(text)
        old = json.loads(start[file]) if file in start else None
        at = old["at"] if old and same_file(old, new) else 0
        for a in range(at, new["at"], split):
            yield file, a, min(a + split, new["at"]), at


class Part(InputPartition):
    def __init__(self, file: str, first: int, end: int, range_start: int):
        super().__init__((file, first))
        self.file, self.first, self.end, self.range_start = file, first, end, range_start


def read_part(part: Part) -> Iterator[pa.RecordBatch]:
    """Lines that begin in the part."""
    system, path = opened(part.file)
    rows: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], schema=ARROW)

    with system.open_input_file(path) as f:
        at = part.first
        if at > part.range_start:  # the line that goes on from the part before is that part's
            at = _after_newline(f, at - 1)
        held, start = b"", at
        f.seek(at)
        while start < part.end:
            block = f.read(BLOCK)
            if not block:
                break
            lines = (held + block).split(b"\n")
            held = lines.pop()
            for line in lines:
                if start >= part.end:
                    break
                if line.strip() and len(line) <= MOST_BYTES:
                    rows.append((start, line.decode("utf-8", "replace")))
                start += len(line) + 1
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


def _after_newline(f, at: int) -> int:
    f.seek(at)
    while block := f.read(BLOCK):
        k = block.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(block)
    return at


class _Files:
    """Lists the files and makes their cursors; what didn't change is remembered."""

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.pv, self.split = int(options.get("parserversion", 1)), int(options.get("splitbytes", SPLIT_BYTES))
        self.known: dict[str, tuple] = {}

    def cursors(self) -> dict[str, str]:
        from pyarrow import fs

        system, path = opened(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = {}
        for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.glob):
                seen = (info.size, info.mtime_ns)
                if self.known.get(info.path, ((), ""))[0] != seen:
                    self.known[info.path] = seen, self._cursor(system, info.path, info.size)
                found[prefix + info.path] = self.known[info.path][1]
        self.known = {p: c for p, c in self.known.items() if prefix + p in found}
        return found

    def _cursor(self, system, path: str, size: int) -> str:
        with system.open_input_file(path) as f:
            head = f.read(min(HEADS[-1], size))
            heads = ",".join(hashlib.sha256(head[:n]).hexdigest()[:16] for n in HEADS if n <= len(head))
            at = size
            while at > 0:  # back to the end of the last whole line
                low = max(0, at - BLOCK)
                f.seek(low)
                k = f.read(at - low).rfind(b"\n")
                if k >= 0:
                    at = low + k + 1
                    break
                at = low
        return json.dumps({"at": at, "size": size, "heads": heads, "pv": self.pv})


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self.files.cursors()}

    def partitions(self, start: dict, end: dict):
        return [Part(*r) for r in ranges(start["files"], end["files"], self.files.split)]

    def read(self, partition: Part):
        return read_part(partition)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self):
        found = [Part(*r) for r in ranges({}, self.files.cursors(), self.files.split)]
        return found or [Part("", 0, 0, 0)]

    def read(self, partition: Part):
        return read_part(partition) if partition.file else iter(())


class GrowingLines(DataSource):
    """Options: path, glob (*.jsonl), parserVersion (1), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))


def growing_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", stream: bool = True, **options):
    """(file, at, value): the lines of files below path, as a stream or in one batch; at is a line's place in bytes."""
    spark.dataSource.register(GrowingLines)
    reader = (spark.readStream if stream else spark.read).format("growing_lines").option("path", path).option("glob", glob)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
