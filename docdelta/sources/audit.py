"""The audit log as a data source (SNK-15): JSON lines in files of a bounded size, of which the newest stay.

    spark.dataSource.register(AuditLog)
    records.write.format("audit_log").mode("append").option("batch", "17").save(folder)

Tasks write what they have to hidden files, a new one when the last is full. The driver's commit gives these their
numbers by renaming them, so a reader (:func:`docdelta.sources.files.read_audit`) sees whole files of finished batches
only, and removes the oldest beyond the backups. A batch that was committed before changes nothing. The folder has to be
one that driver and executors share and see as a path.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import AUDIT_SCHEMA

#: A full file's bytes, and how many full files stay beside the newest.
MAX_BYTES, BACKUPS = 10 * 1024 * 1024, 5


@dataclass
class Written(WriterCommitMessage):
    """The hidden files of a task, in order."""

    files: tuple[str, ...]


class AuditLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def schema(self) -> str:
        return AUDIT_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> AuditWriter:
        if overwrite:
            raise ValueError("an audit log is only appended to")
        return AuditWriter(self.options)


class AuditWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].removeprefix("file:")
        self.batch = options.get("batch") or uuid.uuid4().hex
        self.most, self.backups = int(options.get("maxbytes") or MAX_BYTES), int(options.get("backups") or BACKUPS)
        if not self.batch.replace("-", "").isalnum():
            raise ValueError("a batch is named by letters, digits and hyphens")

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files, out, size = [], None, 0
        try:
            for row in rows:
                line = json.dumps({k: v for k, v in row.asDict(True).items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n"
                if out is None or size >= self.most:
                    if out:
                        out.close()
                    files.append(os.path.join(self.folder, f".{self.batch}-{uuid.uuid4().hex}"))
                    out, size = open(files[-1], "wb"), 0
                size += out.write(line)
        finally:
            if out:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        staged = [f for m in messages if m for f in m.files]
        known = sorted(f for f in os.listdir(self.folder) if f.startswith("audit-")) if os.path.isdir(self.folder) else []
        if any(f.endswith(f"-{self.batch}.jsonl") for f in known):
            self._drop(staged)
            return
        last = int(known[-1].split("-")[1]) if known else 0
        for k, path in enumerate(staged, last + 1):
            name = f"audit-{k:012d}-{self.batch}.jsonl"
            os.rename(path, os.path.join(self.folder, name))
            known.append(name)
        self._drop(os.path.join(self.folder, f) for f in known[: -1 - self.backups])

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(f for m in messages if m for f in m.files)

    @staticmethod
    def _drop(paths) -> None:
        for path in paths:
            if os.path.exists(path):
                os.remove(path)
