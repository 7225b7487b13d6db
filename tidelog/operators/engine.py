"""The persistence engine: a write-ahead log in segments, the event log, a stored manifest and snapshots, in one folder.

A batch goes to the write-ahead log first, then to the event log, then the manifest is stored. Opening replays what a
crash left only in the write-ahead log. All rows are tables; only the manifest (a few lines) passes through the driver.
One writer appends, any number may read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import persistence, scan
from tidelog.schema import EMPTY_ID, NO_SNAPSHOT
from tidelog.sources.shared import Files

SEGMENT_BYTES = 64 << 20
MANIFEST = {"version": 1, "snapshots": [], "last_event_id": "", "last_hlc": 0, "event_count": 0}


def numbered(rows: DataFrame, start: int) -> DataFrame:
    """``rows`` (a written table, whose ``pos`` is the monotonically_increasing_id it was written with) with seq from
    ``start`` on, in the order of pos.

    Such a pos has the partition above 33 bits and the row's place in it below, so rows are moved by the totals of the partitions
    before theirs where they stand: one row a partition is accumulated, not the table, and nothing is sorted.
    """
    part = F.shiftright("pos", 33)
    totals = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(totals), "_part")  # broadcast: a row for each partition of the batch
    return out.withColumn("seq", F.lit(start) + F.col("_before") + F.col("pos").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "pos")


class Engine:
    """An engine over ``folder``. snapshot_interval 0: snapshots only on request; max_segments 0: all are kept."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, snapshot_interval: int = 0, retention: int = persistence.RETENTION,
                 segment_bytes: int = SEGMENT_BYTES, max_segments: int = 0, compression: str = "zstd", clock: Callable[[], int] = time.time_ns):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.interval, self.retention, self.segment_bytes, self.max_segments, self.compression, self.clock = snapshot_interval, retention, segment_bytes, max_segments, compression, clock
        self.files = Files(spark, folder)
        self.manifest = self._load()
        self.recovered = self._recover()

    # --- tables ---

    def _read(self, name: str, more: str) -> DataFrame:
        schema = f"{more}, {self.schema}"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if self.files.exists(name) else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._read("log", "seq BIGINT")

    def wal(self) -> DataFrame:
        """All segments' rows, with the segment they stand in."""
        return self._read("wal", "segment STRING, pos BIGINT")

    def segments(self) -> list[str]:
        return [n.removeprefix("segment=") for n in self.files.names("wal") if n.startswith("segment=")]

    def wal_stats(self) -> DataFrame:
        return self.wal().groupBy("segment").agg(F.count("*").alias("entries"))

    # --- manifest ---

    def _load(self) -> dict:
        return json.loads(self.files.read_text("manifest.json")) if self.files.exists("manifest.json") else json.loads(json.dumps(MANIFEST))

    def _store(self) -> None:
        self.files.write_text("manifest.json", json.dumps(self.manifest))

    # --- writing ---

    def _segment(self) -> str:
        """The active segment, or a new one when it is full; older ones beyond max_segments go."""
        own = self.segments()
        if not own or self.files.size(f"wal/segment={own[-1]}") >= self.segment_bytes:
            own.append(f"{self.clock():020d}-{uuid.uuid4().hex[:8]}")
            if self.max_segments:
                for old in own[: -self.max_segments]:
                    self.files.delete(f"wal/segment={old}")
        return own[-1]

    def append(self, batch: DataFrame) -> int:
        """Appends a batch, all of it or, when an id is empty, nothing; its number of rows."""
        if not batch.filter((F.col("id") == "") | F.col("id").isNull()).isEmpty():
            raise EMPTY_ID
        return self._to_log(self.log_ahead(batch))

    def log_ahead(self, batch: DataFrame) -> DataFrame:
        """Writes a batch to the write-ahead log alone, as a crash would leave it; its rows as written."""
        names, segment, tag = [f.split()[0] for f in self.schema.split(", ")], self._segment(), self.clock()
        at = f"{self.folder}/wal/segment={segment}/batch={tag:020d}"
        batch.select(F.monotonically_increasing_id().alias("pos"), *names).write.parquet(at)
        return self.spark.read.schema(f"pos BIGINT, {self.schema}").parquet(at)

    def _to_log(self, rows: DataFrame) -> int:
        n_before = self.manifest["event_count"]
        numbered(rows, n_before).select("seq", *[f.split()[0] for f in self.schema.split(", ")]).write.mode("append").parquet(f"{self.folder}/log")
        self._repair()
        n = self.manifest["event_count"]
        if self.interval and n // self.interval > n_before // self.interval:
            self.snapshot()
        return n - n_before

    def _repair(self) -> None:
        last = self.log().agg(F.count("*").alias("n"), F.max_by("id", F.struct("hlc", "seq")).alias("id"), F.max("hlc").alias("hlc")).first()
        self.manifest.update(event_count=last["n"], last_event_id=last["id"] or "", last_hlc=last["hlc"] or 0)
        self._store()

    def _recover(self) -> int:
        """Appends what only the write-ahead log has, once for each id; the number of rows."""
        if not self.files.exists("wal"):
            return 0
        lost = persistence.missing(self.wal(), self.log())
        if lost.isEmpty():
            if self.manifest["event_count"] != self.log().count():
                self._repair()
            return 0
        first = lost.groupBy("id").agg(F.min(F.struct("segment", "pos")).alias("_first"))
        lost = lost.join(first, "id").filter(F.struct("segment", "pos") == F.col("_first"))
        # several batches: they follow each other by segment and place. A range-partitioned sort, written so that it is numbered as it stands
        names, at = [f.split()[0] for f in self.schema.split(", ")], f"recovered-{uuid.uuid4().hex}"
        lost.orderBy("segment", "hlc", "pos").select(F.monotonically_increasing_id().alias("pos"), *names).write.parquet(f"{self.folder}/{at}")
        self.manifest["event_count"] = self.log().count()
        n = self._to_log(self.spark.read.schema(f"pos BIGINT, {self.schema}").parquet(f"{self.folder}/{at}"))
        self.files.delete(at)
        return n

    # --- reading ---

    def replay(self) -> DataFrame:
        return self.log().orderBy("seq")

    def replay_from(self, event_id: str | None) -> DataFrame:
        return scan.scan(self.log(), after_id=event_id)

    def replay_range(self, since: int, until: int) -> DataFrame:
        return scan.scan(self.log(), since=since, until=until)

    def stats(self) -> dict:
        return {"events": self.manifest["event_count"], "snapshots": len(self.manifest["snapshots"]), "segments": len(self.segments()), "bytes": self.files.size("log") + self.files.size("wal")}

    # --- snapshots ---

    def snapshot(self) -> dict:
        """Writes the log so far as a snapshot with its metadata; those beyond the retention are deleted."""
        now, upto = self.clock(), self.manifest["event_count"]
        name = f"snap-{now:020d}"
        persistence.write_snapshot(self.log(), f"{self.folder}/snapshots/{name}", upto, self.compression)
        meta = {"id": name, "path": f"snapshots/{name}", "event_id": self.manifest["last_event_id"], "hlc": self.manifest["last_hlc"], "size": self.files.size(f"snapshots/{name}"),
                "created_at": now, "event_from": 0, "event_to": upto}
        known = [*self.manifest["snapshots"], meta]
        self.manifest["snapshots"] = known[-self.retention :]
        self._store()
        for old in known[: -self.retention]:
            self.files.delete(old["path"])
        return meta

    def snapshots(self) -> DataFrame:
        rows = [tuple(s[c.split()[0]] for c in persistence.SNAPSHOT_META.split(", ")) for s in self.manifest["snapshots"]]
        return self.spark.createDataFrame(rows, persistence.SNAPSHOT_META)

    def restore_latest(self, strict: bool = True) -> DataFrame:
        """The newest snapshot's rows, read from it, and those of the log after it."""
        if not self.manifest["snapshots"]:
            if strict:
                raise NO_SNAPSHOT
            return self.replay()
        newest = self.manifest["snapshots"][-1]
        snap = self.spark.read.schema(f"seq BIGINT, {self.schema}").parquet(f"{self.folder}/{newest['path']}")
        return snap.unionByName(self.log().filter(F.col("seq") >= newest["event_to"]))
