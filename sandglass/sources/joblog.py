"""A log that grows by whole jobs: a data source whose writers stage files and whose driver alone makes them visible.

spark.dataSource.register(JobLog); df.write.format("joblog").option("job", name).mode("append").save(folder)

Each task writes one file under ``_staged``, which readers pass over, and tells the driver its name. When all tasks have succeeded the
driver moves the files into the log, one header each; when the job fails it removes them. So a task that is killed, repeated or run twice
leaves no rows, and a reader never sees half of a job. A job that runs again under its name (a micro-batch after a restart)
replaces what it had written; without a name each job is new. As a stream's sink, the batch's number is part of the name.

Options: job; header (true, or false for plain lines); ext (csv).
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..functions.shipping import ship

STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    name: str  # "" of a task without rows
    rows: int


class Appender:
    """What batch and streaming writers share."""

    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.job = options.get("job") or uuid.uuid4().hex
        self.header, self.ext = options.get("header", "true") == "true", options.get("ext", "csv")

    def store(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def stage(self, rows: Iterator[Row], job: str) -> Staged:
        fs, root = self.store()
        first = next(rows, None)
        if first is None:
            return Staged("", 0)
        name, n = f"{job}-{uuid.uuid4().hex}.{self.ext}", 0
        fs.create_dir(f"{root}/{STAGED}", recursive=True)
        try:
            with fs.open_output_stream(f"{root}/{STAGED}/{name}") as sink, io.TextIOWrapper(sink, "utf-8", newline="") as out:
                write = csv.writer(out, lineterminator="\n")
                if self.header:
                    write.writerow(self.columns)
                while first is not None:
                    if self.header:
                        write.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in first])
                    else:
                        out.write(f"{'' if first[0] is None else first[0]}\n")
                    n, first = n + 1, next(rows, None)
        except BaseException:
            if fs.get_file_info(f"{root}/{STAGED}/{name}").type == pyarrow.fs.FileType.File:
                fs.delete_file(f"{root}/{STAGED}/{name}")
            raise
        return Staged(name, n)

    def own(self, folder: str, job: str) -> list[str]:
        """Files of a job in a folder: numbered ones of the log, staged ones with 32 digits of their own."""
        fs, _ = self.store()
        there = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        shape = re.compile(rf"{re.escape(job)}-(\d{{5}}|[0-9a-f]{{32}})\.\w+")
        return [f.path for f in there if f.type == pyarrow.fs.FileType.File and shape.fullmatch(f.base_name)]

    def publish(self, messages: list[Staged | None], job: str) -> None:
        fs, root = self.store()
        fs.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        targets = [f"{root}/{job}-{i:05d}.{self.ext}" for i in range(len(names))]
        before = set(self.own(root, job))
        for name, target in zip(names, targets):
            if target in before:
                fs.delete_file(target)
            fs.move(f"{root}/{STAGED}/{name}", target)
        for old in before - set(targets):
            fs.delete_file(old)
        self.discard(job)

    def discard(self, job: str) -> None:
        """Removes what is staged for a job, also by tasks that were lost."""
        fs, root = self.store()
        for path in self.own(f"{root}/{STAGED}", job):
            fs.delete_file(path)


class BatchLog(Appender, DataSourceWriter):
    def write(self, iterator):
        return self.stage(iter(iterator), self.job)

    def commit(self, messages):
        self.publish(messages, self.job)

    def abort(self, messages):
        self.discard(self.job)


class StreamLog(Appender, DataSourceStreamWriter):
    """A batch's number is only known when it is committed, so tasks stage under the query's name."""

    def write(self, iterator):
        return self.stage(iter(iterator), self.job)

    def commit(self, messages, batchId):
        self.publish(messages, f"{self.job}-{batchId:08d}")

    def abort(self, messages, batchId):
        fs, root = self.store()
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{root}/{STAGED}/{m.name}").type == pyarrow.fs.FileType.File:
                fs.delete_file(f"{root}/{STAGED}/{m.name}")


class JobLog(DataSource):
    @classmethod
    def name(cls):
        return "joblog"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return BatchLog(self.options, schema.fieldNames())

    def streamWriter(self, schema, overwrite):
        return StreamLog(self.options, schema.fieldNames())


def append(df: DataFrame, path: str, job: str | None = None, **options: str) -> None:
    """The rows of df at the end of the log, all or none."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(JobLog)
    out = df.write.format("joblog").mode("append").options(**options)
    (out.option("job", job) if job else out).save(path)
