"""A data source of zipped archives: ``spark.read.format("folio_archive").load(path)``.

One row per member: path and size of the archive, ordinal and name of the member, its
compression method, stored and original length, content, error.  An archive that cannot be
read is one row without a name, a member that cannot be read has no content; both say why.

Planning lists the files.  Small archives are dealt into partitions whole; of an archive
larger than `splitBytes` the end record and the central directory alone are read, by
range, and its members become partitions of about that size.  A task seeks to its members;
no archive is ever held whole.  Filters on `name` and `path` reach the source where
``spark.sql.python.filterPushdown.enabled`` is set: members that they leave out are not
decompressed, archives that they leave out are not opened.

Options: `path` (a file, a folder or a pattern; several by line breaks), `recursive`
(true), `splitBytes` (64 MB), `content` (true; false lists members only).  Files are opened
with pyarrow's file systems; archives in stores that only Spark's own readers reach go
through ``archive.archive_members`` instead.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SPLIT_BYTES = 64 << 20
#: A batch goes to Spark when it holds so many bytes of content or rows; a larger member is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000

#: What reading an archive that is none can raise; too short ones end in a place that no file has, a ValueError of pyarrow.
BROKEN = (OSError, ValueError, zipfile.BadZipFile)

SCHEMA = "path string, size bigint, ordinal int, name string, method int, stored bigint, length bigint, content binary, error string"
ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("ordinal", pa.int32()), ("name", pa.string()), ("method", pa.int32()), ("stored", pa.int64()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


@dataclass
class Members(InputPartition):
    """Archives (path, size, first member, last member or None for all)."""

    archives: list[tuple[str, int, int, int | None]] = field(default_factory=list)
    bytes: int = 0


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(pattern: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, of one file or of those that a pattern names, in order."""
    system, path = opened(pattern)
    scheme = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    plain = path
    while any(c in plain for c in "*?["):
        plain = posixpath.dirname(plain)
    found = system.get_file_info(plain)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(pattern)
    if found.type == fs.FileType.File:
        return [(pattern, found.size)]
    files = [f for f in system.get_file_info(fs.FileSelector(plain, recursive=recursive or plain != path)) if f.type == fs.FileType.File]
    hidden = lambda f: f.base_name.startswith((".", "_"))  # noqa: E731  as Spark's own sources
    return sorted((scheme + f.path, f.size) for f in files if not hidden(f) and (plain == path or fnmatch.fnmatchcase(f.path, path)))


def tests_of(filters: Iterable[Filter]) -> tuple[dict[str, list[Callable[[str], bool]]], list[Filter]]:
    """What `name` and `path` have to fulfil, and the filters that are left to Spark."""
    tests: dict[str, list[Callable[[str], bool]]] = {"name": [], "path": []}
    left = []
    for f in filters:
        own = tests.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        made = {
            EqualTo: lambda f: lambda x, v=f.value: x == v, In: lambda f: lambda x, v=frozenset(f.value): x in v, StringStartsWith: lambda f: lambda x, v=f.value: x.startswith(v),
            StringEndsWith: lambda f: lambda x, v=f.value: x.endswith(v), StringContains: lambda f: lambda x, v=f.value: v in x,
        }.get(type(f))
        if own is None or made is None:
            left.append(f)
        else:
            own.append(made(f))
    return tests, left


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.content = options.get("content", "true").lower() == "true"
        self.tests: dict[str, list] = {"name": [], "path": []}
        if not self.paths:
            raise ValueError("an archive source needs a path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.tests, left = tests_of(filters)
        return left

    def partitions(self) -> list[Members]:
        parts, small = [], Members()
        for path, size in (x for p in self.paths for x in listed(p, self.recursive)):
            if not all(t(path) for t in self.tests["path"]):
                continue
            runs = self.runs_of(path) if size > self.split else None
            if runs:
                parts += [Members([(path, size, a, b)]) for a, b in runs]
                continue
            if small.archives and small.bytes + size > self.split:
                parts, small = [*parts, small], Members()
            small.archives.append((path, size, 0, None))
            small.bytes += size
        return [*parts, small] if small.archives or not parts else parts

    def runs_of(self, path: str) -> list[tuple[int, int]] | None:
        """Members of a large archive in runs of about `split` stored bytes; None if its directory cannot be read."""
        system, plain = opened(path)
        try:
            with system.open_input_file(plain) as f, zipfile.ZipFile(f) as z:
                sizes = [m.compress_size for m in z.infolist()]
        except BROKEN:
            return None
        runs, first, held = [], 0, 0
        for k, size in enumerate(sizes):
            if k > first and held + size > self.split:
                runs, first, held = [*runs, (first, k)], k, 0
            held += size
        return [*runs, (first, len(sizes))]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for archive in partition.archives:
            for row in self.members(*archive):
                size = len(row["content"] or b"")
                if rows and (held + size > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
                rows.append(row)
                held += size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def members(self, path: str, size: int, first: int, last: int | None) -> Iterator[dict]:
        system, plain = opened(path)
        none = dict.fromkeys(ARROW.names) | {"path": path, "size": size}
        try:
            with system.open_input_file(plain) as f, zipfile.ZipFile(f) as z:
                for k, m in enumerate(z.infolist()[first:last], first):
                    if m.is_dir() or not all(t(m.filename) for t in self.tests["name"]):
                        continue
                    row = none | {"ordinal": k, "name": m.filename, "method": m.compress_type, "stored": m.compress_size, "length": m.file_size}
                    try:
                        row["content"] = z.read(m) if self.content else None
                    except Exception as e:  # one member's fault is not the archive's
                        row["error"] = str(e) or type(e).__name__
                    yield row
        except BROKEN as e:
            if not self.tests["name"]:
                yield none | {"error": str(e) or type(e).__name__}


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
