"""Counters, gauges and histograms of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Upper bounds of the default histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def by_type_node(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type", "originator").agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, buckets=BUCKETS) -> DataFrame:
    """(le, n): values up to each bound, in one pass; le is text, the last +Inf."""
    counts = values.agg(*(F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(buckets)), F.count(column).alias("all"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select(F.inline(F.array(*rows)))


def exposition(counters: DataFrame, name: str) -> DataFrame:
    """Counters (event_type, originator, n) as lines of text."""
    return counters.select(F.format_string(name + '{type="%s",node="%s"} %d', "event_type", "originator", "n").alias("line"))


def created_applied(log: DataFrame, node_id: str) -> DataFrame:
    """(label, node, created, applied): events that ``node_id`` made and those it took over, by label."""
    own = F.col("originator") == node_id
    return log.groupBy(F.col("op").alias("label")).agg(F.lit(node_id).alias("node"), F.count_if(own).alias("created"), F.count_if(~own).alias("applied"))


def snapshots_taken(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("snapshots"), F.max("event_to").alias("events"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df``, and what is counted while its rows go by: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *(m.alias(k) for k, m in metrics.items())), seen
