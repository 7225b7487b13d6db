"""Scans of an event log: filters that reach the file reader, point lookup, statistics, state at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import EMPTY_ID, EVENT_NOT_FOUND

COMPAT_LIMIT = 1000


def _place(log: DataFrame, event_id: str) -> int | None:
    """seq of an id's last occurrence."""
    return log.filter(F.col("id") == event_id).agg(F.max("seq")).first()[0]


def scan(log: DataFrame, *, after_id: str | None = None, before_id: str | None = None, group_id: str | None = None, session_id: str | None = None,
         since: int | None = None, until: int | None = None, limit: int | None = None, reverse: bool = False, compat: bool = False) -> DataFrame:
    """Rows in append order that meet all conditions; bounds of hlc are inclusive.

    An unknown after_id or before_id does not restrict. compat: a limit that is not given is COMPAT_LIMIT, before_id leaves
    out that row only, and reverse gives the last row at most. Places are looked up first, so that all
    conditions are literals that the file reader can use.
    """
    for column, value in (("group_id", group_id), ("session_id", session_id)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    if since:
        log = log.filter(F.col("hlc") >= since)
    if until:
        log = log.filter(F.col("hlc") <= until)
    if after_id is not None and (at := _place(log, after_id)) is not None:
        log = log.filter(F.col("seq") > at)
    if before_id is not None:
        if compat:
            log = log.filter(F.col("id") != before_id)
        elif (at := _place(log, before_id)) is not None:
            log = log.filter(F.col("seq") < at)
    if compat:
        log = log.orderBy(F.desc("seq")).limit(1) if reverse else log
        limit = COMPAT_LIMIT if not limit or limit < 0 else limit
    log = log.orderBy(F.desc("seq") if reverse else F.asc("seq"))
    return log.limit(limit) if limit and limit > 0 else log


def get(log: DataFrame, event_id: str, strict: bool = False) -> DataFrame:
    """The last row with an id; none, or an error if strict, when there is none."""
    found = log.filter(F.col("id") == event_id).orderBy(F.desc("seq")).limit(1)
    if strict and found.isEmpty():
        raise EVENT_NOT_FOUND
    return found


def stats(log: DataFrame) -> DataFrame:
    """Events (duplicates counted), and the oldest and newest id in append order."""
    return log.agg(F.count("*").alias("event_count"), F.min_by("id", "seq").alias("oldest_id"), F.max_by("id", "seq").alias("newest_id"))


def append(log_path: str, batch: DataFrame) -> None:
    """Appends a batch, all of it or, when an id is empty, nothing."""
    if not batch.filter((F.col("id") == "") | F.col("id").isNull()).isEmpty():
        raise EMPTY_ID
    batch.write.mode("append").parquet(log_path)


def dedupe(log: DataFrame) -> DataFrame:
    """The first row of each id, in append order."""
    first = log.groupBy("id").agg(F.min("seq").alias("seq"))
    return log.join(first, ["id", "seq"], "left_semi")


def at_time(log: DataFrame, hlc: int) -> DataFrame:
    return log.filter(F.col("hlc") <= hlc)
