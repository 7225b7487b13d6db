"""Peers and what each of them lacks: tables (peer_id, state) and (peer_id, group_id, originator, hlc)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import SYNC_STATES

IDLE = SYNC_STATES[0]


def register(peers: DataFrame, versions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new`` (peer_id) put in as idle; one that was known starts again, without versions."""
    ids = new.select("peer_id").distinct()
    return peers.join(ids, "peer_id", "left_anti").unionByName(ids.withColumn("state", F.lit(IDLE))), versions.join(ids, "peer_id", "left_anti")


def remove(peers: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("peer_id")
    return peers.join(ids, "peer_id", "left_anti"), versions.join(ids, "peer_id", "left_anti")


def get(peers: DataFrame, peer_id: str) -> DataFrame:
    return peers.filter(F.col("peer_id") == peer_id)


def count(peers: DataFrame) -> DataFrame:
    return peers.agg(F.count("*").alias("n"))


def set_state(peers: DataFrame, changes: DataFrame) -> DataFrame:
    """The states of ``changes`` (peer_id, state); unknown peers are left out."""
    new = changes.select("peer_id", F.col("state").alias("_state"))
    return peers.join(new, "peer_id", "left").select("peer_id", F.coalesce("_state", "state").alias("state"))


def merge_versions(versions: DataFrame, more: DataFrame) -> DataFrame:
    return versions.unionByName(more).groupBy("peer_id", "group_id", "originator").agg(F.max("hlc").alias("hlc"))


def delta_all(log: DataFrame, peers: DataFrame, versions: DataFrame) -> DataFrame:
    """(peer_id, known, events): clocks of which a peer knows something, and the events it lacks in all groups.

    What a peer lacks is all events without those it has seen, so only what it knows meets the log: the log's counts by
    (group, originator, hlc). No row is made for a peer and a group that it has never heard of.
    """
    clocks = log.groupBy("group_id", "originator", "hlc").agg(F.count("*").alias("n"))
    seen = versions.join(peers.select("peer_id"), "peer_id", "left_semi").withColumnRenamed("hlc", "_seen")
    had = seen.join(clocks, ["group_id", "originator"]).groupBy("peer_id").agg(F.sum(F.when(F.col("hlc") <= F.col("_seen"), F.col("n")).otherwise(0)).alias("had"))
    known = seen.groupBy("peer_id").agg(F.count("*").alias("known"))
    total = log.count()
    out = peers.select("peer_id").join(had, "peer_id", "left").join(known, "peer_id", "left")
    return out.select("peer_id", F.coalesce("known", F.lit(0)).cast("long").alias("known"), (F.lit(total) - F.coalesce("had", F.lit(0))).alias("events"))


def filter_items(log: DataFrame) -> DataFrame:
    """What a peer's Bloom filter holds: each group, and each originator in it."""
    vector = log.select("group_id", "originator").distinct()
    return vector.select("group_id").distinct().select(F.col("group_id").alias("item")).unionByName(vector.select(F.concat_ws(":", "group_id", "originator").alias("item")))


def filter_size(log: DataFrame) -> int:
    """The number of items that the filter is made for: the sizes of all vectors, 100 if there are less than 10."""
    n = log.select("group_id", "originator").distinct().count()
    return n if n >= 10 else 100


# --- messages -----------------------------------------------------------------------------------------------------


def sync_request(log: DataFrame, node_id: str) -> DataFrame:
    """One row: a request for all groups, as JSON."""
    groups = log.agg(F.array_sort(F.collect_set("group_id")).alias("groups"))  # a value for each group
    return groups.select(F.to_json(F.struct(F.lit(node_id).alias("node_id"), "groups")).alias("request"))


def read_request(requests: DataFrame) -> DataFrame:
    """(node_id, group_id) of requests."""
    r = F.from_json("request", "node_id string, groups array<string>, filter binary, versions map<string,bigint>")
    return requests.select(r.alias("r")).select("r.node_id", F.explode("r.groups").alias("group_id"))


EVENT_FIELDS = ("id", "hlc", "originator", "session_id", "group_id")


def events_json(log: DataFrame, by: str = "group_id") -> DataFrame:
    """(by, n, events): the events of each key as a JSON array in append order. A message holds one key's events."""
    one = F.struct("seq", F.to_json(F.struct(*EVENT_FIELDS)).alias("j"))
    each = log.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("e"))
    return each.select(by, F.size("e").cast("long").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("]")).alias("events"))


def read_events(messages: DataFrame) -> DataFrame:
    kind = "array<struct<id:string,hlc:bigint,originator:string,session_id:string,group_id:string>>"
    return messages.select(F.inline(F.from_json("events", kind)))
