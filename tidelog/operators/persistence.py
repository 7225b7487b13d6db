"""Recovery, manifests, snapshots and retention of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import NO_SNAPSHOT, SNAPSHOT_META  # noqa: F401 (part of this module's interface)

RETENTION = 5


def missing(wal: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the write-ahead log whose id the log lacks."""
    return wal.join(log.select("id"), "id", "left_anti")


def recover(wal: DataFrame, log: DataFrame) -> DataFrame:
    return log.unionByName(missing(wal, log).select(*log.columns))


def manifest(log: DataFrame) -> DataFrame:
    return log.agg(F.lit(1).alias("version"), F.count("*").alias("event_count"), F.max_by("id", "seq").alias("last_event_id"), F.max("hlc").alias("last_hlc"), F.max_by("id", F.struct("hlc", "seq")).alias("max_hlc_event_id"))


def boundaries(batches: DataFrame, interval: int) -> DataFrame:
    """Batches (batch, rows) after which a snapshot is due: the count of events crosses a multiple of ``interval``.

    One row a batch is accumulated in order.
    """
    upto = F.sum("rows").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    b = batches.withColumn("event_to", upto)
    return b.filter(F.floor(F.col("event_to") / interval) > F.floor((F.col("event_to") - F.col("rows")) / interval))


def retained(snapshots: DataFrame, keep: int = RETENTION) -> DataFrame:
    """The newest ``keep`` snapshots."""
    return snapshots.orderBy(F.desc("event_to")).limit(keep)


def write_snapshot(log: DataFrame, path: str, upto: int, codec: str = "zstd") -> None:
    """The first ``upto`` rows of a log whose seq starts at 0."""
    log.filter(F.col("seq") < upto).write.option("compression", codec).parquet(path)


def restore_latest(log: DataFrame, snapshots: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of the log up to the newest snapshot's end."""
    newest = snapshots.agg(F.max("event_to")).first()[0]
    if newest is None and strict:
        raise NO_SNAPSHOT
    return log.filter(F.col("seq") < (newest or 0))
