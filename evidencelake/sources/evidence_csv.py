"""A data source that writes CSV exports as they are exchanged: `rows.write.format("evidence_csv").mode("append").save(path)`.

Every file has the header, fields are quoted after RFC 4180 and lines end with CR and LF. A task writes below
`_temporary`; its file gets its name when all tasks have come to their end, so a task that fails, or a job that is
given up, leaves no file, and a repeated task leaves one. Paths are those of pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "evidence_csv"


def text_of(value) -> str:
    """A field before quoting: null is empty, booleans are lower-case as in JSON."""
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def field(value) -> str:
    s = text_of(value)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in '",\r\n') else s


def line(values) -> bytes:
    return (",".join(map(field, values)) + "\r\n").encode()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    n_rows: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class CsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path.rstrip("/"), columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = located(self.path)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        temporary, n = f"{root}/_temporary/{self.job}/{part:05d}-{attempt}.csv", 0
        system.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
        try:
            with system.open_output_stream(temporary) as out:
                out.write(line(self.columns))
                for batch in iterator:
                    columns = [c.to_pylist() for c in batch.columns]
                    out.write(b"".join(map(line, zip(*columns, strict=True))))
                    n += len(batch)
        except BaseException:
            if system.get_file_info(temporary).type != fs.FileType.NotFound:
                system.delete_file(temporary)
            raise
        return Written(temporary, f"{root}/part-{part:05d}-{self.job}.csv", n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        old = [] if not self.overwrite else [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".csv")]
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)
        for path in old:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        for folder in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            known = system.get_file_info(folder).type == fs.FileType.Directory
            if known and (folder.endswith(self.job) or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class EvidenceCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EvidenceCsv)
