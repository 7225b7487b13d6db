"""Replicated states as mergeable aggregates: registers, maps, counters, texts.

The order of writes is (hlc, originator, id), which converges; order="arrival" is the append order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(order: str = "clock") -> Column:
    return F.col("seq") if order == "arrival" else F.struct("hlc", "originator", "id")


def lww_register(log: DataFrame, by: Iterable[str], value: str = "value", order: str = "clock") -> DataFrame:
    """Each register's last written value."""
    return log.groupBy(*by).agg(F.max_by(value, stamp(order)).alias("value"))


def since_reset(log: DataFrame, by: str, reset: Column) -> DataFrame:
    """The rows after each register's last reset; a register that was only reset has none."""
    last = log.groupBy(by).agg(F.max(F.when(reset, F.col("seq"))).alias("_reset"))
    return log.join(last, by).filter(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def lww_map(log: DataFrame, order: str = "clock") -> DataFrame:
    """(group_id, key, value): a row for each key that was ever set; a deleted one has no value."""
    value = F.when(F.col("op") == "map_set", F.col("value"))
    state = log.filter(F.col("op").isin("map_set", "map_delete")).groupBy("group_id", "key").agg(F.max_by(value, stamp(order)).alias("value"), F.count_if(F.col("op") == "map_set").alias("_sets"))
    return state.filter("_sets > 0").drop("_sets")


def map_sizes(state: DataFrame) -> DataFrame:
    """Live keys, and all with the deleted ones."""
    return state.groupBy("group_id").agg(F.count("value").alias("live"), F.count("*").alias("total"))


def map_keys(state: DataFrame) -> DataFrame:
    return state.filter("value IS NOT NULL").groupBy("group_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def lww_merge(states: Iterable[DataFrame], by: Iterable[str]) -> DataFrame:
    """Merges states of (by, value, hlc, originator, id): the greatest stamp of each key."""
    states = list(states)
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy(*by).agg(F.max_by("value", F.struct("hlc", "originator", "id")).alias("value"))


def gcounter(log: DataFrame) -> DataFrame:
    """(group_id, originator, count): increments add up within a replica."""
    return log.groupBy("group_id", "originator").agg(F.sum("delta").alias("count"))


def gcounter_merge(*states: DataFrame) -> DataFrame:
    """Replicas' states merge by the greatest count of each node."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy("group_id", "originator").agg(F.max("count").alias("count"))


def gcounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("group_id").agg(F.sum("count").alias("value"))


def pncounter(log: DataFrame) -> DataFrame:
    """(group_id, originator, positive, negative)."""
    d = F.col("delta")
    return log.groupBy("group_id", "originator").agg(F.sum(F.when(d >= 0, d).otherwise(0)).alias("positive"), F.sum(F.when(d < 0, -d).otherwise(0)).alias("negative"))


def pncounter_merge(*states: DataFrame) -> DataFrame:
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy("group_id", "originator").agg(F.max("positive").alias("positive"), F.max("negative").alias("negative"))


def pncounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("group_id").agg((F.sum("positive") - F.sum("negative")).alias("value"))


# --- text ---------------------------------------------------------------------------------------------------------


def insert(text: Column, pos: Column, piece: Column) -> Column:
    """``piece`` in front of the character at ``pos``; before the first for pos < 0, after the last for one past the end."""
    p = F.greatest(pos, F.lit(0)).cast("int")
    return F.concat(F.substring(text, F.lit(1), p), piece, F.substring(text, p + 1, F.length(text)))


def delete(text: Column, pos: Column, n: Column) -> Column:
    """Without the characters from ``pos`` on, ``n`` of them."""
    p, end = F.greatest(pos, F.lit(0)).cast("int"), F.greatest(pos + n, F.lit(0)).cast("int")
    return F.when(end <= p, text).otherwise(F.concat(F.substring(text, F.lit(1), p), F.substring(text, end + 1, F.length(text))))


def text_fold(ops: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """(by, text): edits (op, position, text, length) of each text applied in order.

    One text's edits meet in one task, as each depends on the last; ``fold_in_pandas`` takes long histories.
    """
    step = lambda s, o: F.when(o["op"] == "text_insert", insert(s, o["position"], o["text"])).when(o["op"] == "text_delete", delete(s, o["position"], o["length"])).otherwise(s)
    each = ops.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "op", "position", "text", "length"))).alias("_ops"))
    return each.select(by, F.aggregate("_ops", F.lit(""), step).alias("text"))


def fold_in_pandas(ops: DataFrame, by: str, order: str = "seq") -> DataFrame:
    def fold(pdf):
        import pandas as pd

        text = ""
        for op, pos, piece, n in pdf.sort_values(order)[["op", "position", "text", "length"]].itertuples(index=False):
            if op == "text_insert":
                pos = max(int(pos), 0)
                text = text[:pos] + piece + text[pos:]
            elif op == "text_delete":
                lo, hi = max(int(pos), 0), max(int(pos + n), 0)
                text = text if hi <= lo else text[:lo] + text[hi:]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "text": [text]})

    return ops.groupBy(by).applyInPandas(fold, f"{by} {ops.schema[by].dataType.simpleString()}, text string")


def rga_merge(*states: DataFrame) -> DataFrame:
    """(doc_id, ts, node, ch, removed): nodes of all states once each; removed if any state says so."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy("doc_id", "ts", "node").agg(F.max("ch").alias("ch"), F.bool_or("removed").alias("removed"))


def rga_text(state: DataFrame) -> DataFrame:
    """(doc_id, text, length) of the live nodes in the order of their ids."""
    live = state.filter("NOT removed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ts", "node", "ch"))).alias("n"))
    return live.select("doc_id", F.array_join(F.transform("n", lambda x: x["ch"]), "").alias("text"), F.size("n").cast("long").alias("length"))


def rga_compact(state: DataFrame) -> DataFrame:
    return state.filter("NOT removed")
