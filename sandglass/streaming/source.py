"""The queue's folder as a stream: a data source that admits its files in the order of their names, some a batch.

spark.dataSource.register(QueueSource); spark.readStream.format("queue").option("folder", ...).option("log", ...).load()

When a batch is planned, the files that are new since the last one are sorted by name and the first of them, up to ``admit``, are written
to the log, which is what offsets count. Names that sort before those already admitted are taken in a later batch, none is left out,
and a batch that is run again after a restart reads what the log says it had. A file counts as new again when it was written
anew. Only the driver lists the folder and appends to the log; contents are read by tasks.

Options: folder and log, local or mounted paths that driver and executors share; suffixes, comma-separated (.meta); admit (2).
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Files that one task reads.
SLICE = 64


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class QueueReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.log = options["folder"], options["log"]
        self.suffixes, self.admit = tuple(options.get("suffixes", ".meta").split(",")), int(options.get("admit", "2"))
        self.keys: list[str] | None = None  # name@time of all admitted, in order
        self.seen: set[str] = set()

    def admitted(self) -> list[str]:
        if self.keys is None:
            self.keys = []
            for entry in sorted(os.listdir(self.log)) if os.path.isdir(self.log) else []:
                if entry.isdigit():
                    with open(os.path.join(self.log, entry), encoding="utf-8") as f:
                        self.keys += json.load(f)
            self.seen = set(self.keys)
        return self.keys

    def initialOffset(self):
        return {"n": 0}

    def waiting(self, most: int = 1) -> list[str]:
        """The first files, by name, that were not admitted yet."""
        self.admitted()
        new: list[str] = []
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if len(new) < most and entry.name.endswith(self.suffixes):
                try:
                    key = f"{entry.name}@{entry.stat().st_mtime_ns}"
                except FileNotFoundError:  # taken away since it was listed
                    continue
                if key not in self.seen:
                    new.append(key)
        return new

    def latestOffset(self):
        known, new = self.admitted(), self.waiting(self.admit)
        if new:
            os.makedirs(self.log, exist_ok=True)
            entry = os.path.join(self.log, f"{len(known):012d}")
            with open(f"{entry}.new", "w", encoding="utf-8") as f:
                json.dump(new, f)
            os.replace(f"{entry}.new", entry)
            known += new
            self.seen.update(new)
        return {"n": len(known)}

    def partitions(self, start, end):
        names = [k.rpartition("@")[0] for k in self.admitted()[start["n"] : end["n"]]]
        return [Files(names[i : i + SLICE]) for i in range(0, len(names), SLICE)] or [Files([])]

    def read(self, partition):
        for name in partition.names:
            try:
                with open(os.path.join(self.folder, name), encoding="utf-8", errors="replace") as f:
                    value = f.read() if name.endswith(".meta") else None
                at = os.path.getmtime(os.path.join(self.folder, name))
            except FileNotFoundError:  # gone since it was admitted
                continue
            yield name, value, datetime.fromtimestamp(at, UTC)

    def commit(self, end):
        pass

    def stop(self):
        pass


class QueueSource(DataSource):
    @classmethod
    def name(cls):
        return "queue"

    def schema(self):
        return "name string, value string, at timestamp"

    def streamReader(self, schema):
        return QueueReader(self.options)
