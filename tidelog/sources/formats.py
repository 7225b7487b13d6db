"""Python data sources for the byte formats: spark.read.format("tide_log" | "tide_wal" | "tide_snapshot" | "tide_frames").load(folder).

Each file of the folder is a partition, read on an executor. The folder must be one that all executors see, mounted alike.
Files are named by time and place in the write, so that they sort in the order they were written; a task writes under
a name of its attempt, and only what is committed gets its final name.

Options: mode (FAILFAST, DROPMALFORMED, PERMISSIVE) for reading; start_offset for tide_wal (the byte in the order of all
segments from which entries are read); segment_bytes for tide_wal and tide_log (a file's size from which the next begins).
"""

from __future__ import annotations

import gzip
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidelog.schema import MESSAGES, WAL
from tidelog.sources import codec

LOG = "_file STRING, _offset BIGINT, id STRING, causal_deps ARRAY<STRING>, payload_type STRING, payload BINARY, hlc BIGINT, originator STRING, signature BINARY, session_id STRING, group_id STRING"


def files(path: str, suffix: str) -> list[str]:
    return [path] if os.path.isfile(path) else sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(suffix))


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "FAILFAST").upper()

    def partitions(self):
        return [InputPartition(f) for f in files(self.path, self.suffix)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is not None and partition.value:
            with open(partition.value, "rb") as f:
                yield from self.rows(partition.value, f)


class _LogReader(_Reader):
    suffix = ".log"

    def rows(self, name, f):
        for at, e in codec.frames(f):
            yield (os.path.basename(name), at, *(e[c] for c, _, _ in codec.FIELDS))


class _WalReader(_Reader):
    suffix = ".wal"

    def __init__(self, options):
        super().__init__(options)
        self.start = int(options.get("start_offset", 0))

    def partitions(self):
        out, before = [], 0
        for name in files(self.path, self.suffix):
            size = os.path.getsize(name)
            if before + size > self.start:
                out.append(InputPartition((name, max(0, self.start - before))))
            before += size
        return out

    def read(self, partition):
        if partition is not None and partition.value:
            name, start = partition.value
            with open(name, "rb") as f:
                for at, ok, body in codec.wal_entries(f, self.mode):
                    if at >= start:
                        yield os.path.basename(name), at, ok, body


class _SnapshotReader(_Reader):
    suffix = ".snap"

    def rows(self, name, f):
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        with gzip.open(f) if packed else f as whole:
            for header, e in codec.snapshot_events(whole):
                yield (header.get("id"), *(e[c] for c, _, _ in codec.FIELDS))


class _FrameReader(_Reader):
    suffix = ".frames"

    def rows(self, name, f):
        yield from codec.messages(f)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # temporary and final names


class _Writer(DataSourceWriter):
    def __init__(self, options, schema, encode, suffix):
        self.path, self.names, self.encode, self.suffix = options["path"], schema.fieldNames(), encode, suffix
        self.segment_bytes, self.began = int(options.get("segment_bytes", 1 << 62)), time.time_ns()

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task, out, f, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for row in rows:
                data = self.encode(dict(zip(self.names, row, strict=True)))
                if f is None or size >= self.segment_bytes:
                    if f:
                        f.close()
                    name = os.path.join(self.path, f"{self.began:020d}-{task:05d}-{len(out):05d}-{uuid.uuid4().hex[:8]}{self.suffix}")
                    out.append((f"{name}.tmp", name))
                    f, size = open(f"{name}.tmp", "wb"), 0
                f.write(data)
                size += len(data)
        finally:
            if f:
                f.close()
        return _Written(out)

    def commit(self, messages):
        for tmp, name in (x for m in messages if m for x in m.files):
            os.replace(tmp, name)

    def abort(self, messages):
        for tmp, _ in (x for m in messages if m for x in m.files):
            if os.path.exists(tmp):
                os.remove(tmp)


class EventLogSource(DataSource):
    @classmethod
    def name(cls):
        return "tide_log"

    def schema(self):
        return LOG

    def reader(self, schema):
        return _LogReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, codec.frame, ".log")


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "tide_wal"

    def schema(self):
        return WAL

    def reader(self, schema):
        return _WalReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, codec.wal_entry, ".wal")


class SnapshotSource(DataSource):
    """Snapshot files, packed with gzip or not, as their events; read only."""

    @classmethod
    def name(cls):
        return "tide_snapshot"

    def schema(self):
        return LOG.replace("_file STRING, _offset BIGINT", "snapshot_id STRING")

    def reader(self, schema):
        return _SnapshotReader(self.options)


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "tide_frames"

    def schema(self):
        return MESSAGES

    def reader(self, schema):
        return _FrameReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, lambda r: codec.message(r["msg_type"], r["group_id"], bytes(r["payload"])), ".frames")


SOURCES = (EventLogSource, WalSource, SnapshotSource, FrameSource)


def available() -> list[str]:
    return sorted(s.name() for s in SOURCES)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
