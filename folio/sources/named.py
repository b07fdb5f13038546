"""A data source that writes rows (name, value) as files of those names:
``df.write.format("folio_named").mode("append").save(path)``.

Tasks write to a folder of the job's own beside the files.  Commit moves the files to
their names, each in one step, replacing one that is there; before that it refuses names
that two rows share.  Abort, and a failed commit, delete the job's folder: a failed task
leaves no file.  Names without a slash only; a null value is an empty file.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folio.sources.zipped import opened


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, name) of what a task has written."""

    files: list[tuple[str, str]]


class NamedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def place(self) -> tuple[fs.FileSystem, str]:
        return opened(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = self.place()
        system.create_dir(f"{top}/{self.job}", recursive=True)
        out = []
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith("_job-"):
                raise ValueError(f"not a file's name: {row.name!r}")
            temporary = f"{top}/{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write((row.value or "").encode())
            out.append((temporary, row.name))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        system, top = self.place()
        try:
            if twice := [n for n, k in Counter(n for _, n in files).items() if k > 1]:
                raise ValueError(f"names of several rows: {sorted(twice)[:5]}")
            for temporary, name in files:
                system.move(temporary, f"{top}/{name}")
        finally:
            self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, top = self.place()
        if system.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_named"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        if [f.name for f in schema.fields] != ["name", "value"]:
            raise ValueError("rows of this source are (name, value)")
        return NamedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
