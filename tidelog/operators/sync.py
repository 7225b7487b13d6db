"""Version vectors and what one replica lacks of another: joins instead of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_vector(log: DataFrame, mode: str = "max") -> DataFrame:
    """(group_id, originator, hlc): the greatest clock of each originator, or the last applied one."""
    hlc = F.max("hlc") if mode == "max" else F.max_by("hlc", "seq")
    return log.groupBy("group_id", "originator").agg(hlc.alias("hlc"))


def merge(*vectors: DataFrame) -> DataFrame:
    union = vectors[0]
    for v in vectors[1:]:
        union = union.unionByName(v)
    return union.groupBy("group_id", "originator").agg(F.max("hlc").alias("hlc"))


def delta(local: DataFrame, peer: DataFrame) -> DataFrame:
    """Entries of ``local`` that ``peer`` lacks or has older."""
    p = peer.select(F.col("group_id").alias("g"), F.col("originator").alias("o"), F.col("hlc").alias("h"))
    return local.join(p, (F.col("group_id") == F.col("g")) & (F.col("originator") == F.col("o")) & (F.col("hlc") <= F.col("h")), "left_anti")


def events_to_send(log: DataFrame, peer: DataFrame) -> DataFrame:
    """Events later than the peer's entry for their originator."""
    p = peer.select("group_id", "originator", F.col("hlc").alias("_peer"))
    return log.join(p, ["group_id", "originator"], "left").filter(F.col("_peer").isNull() | (F.col("hlc") > F.col("_peer"))).drop("_peer")


def sync_response(log: DataFrame, node_id: str) -> DataFrame:
    """One row a group: its vector as JSON, its size and its events."""
    each = log.groupBy("group_id", "originator").agg(F.max("hlc").alias("hlc"), F.count("*").alias("n"))
    out = each.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("originator", "hlc"))).alias("v"), F.count("*").alias("vector_size"), F.sum("n").alias("event_count"))
    return out.select(F.lit(node_id).alias("node_id"), "group_id", F.to_json(F.map_from_entries("v")).alias("versions"), "vector_size", "event_count")


def apply_response(response: DataFrame) -> DataFrame:
    """The version vector that a response's JSON holds."""
    return response.select("group_id", F.explode(F.from_json("versions", "map<string,bigint>")).alias("originator", "hlc"))


def known_peers(peers: DataFrame) -> DataFrame:
    return peers.groupBy("peer_id").agg(F.max_by("state", "seq").alias("state"))
