"""The test tables as an event log: DataFrames, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hlc(ts: str) -> Column:
    """Nanoseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) * 1000")


def as_log(events: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    originator = F.concat(F.lit("u"), F.col("user_id"))
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), hlc("ts").alias("hlc"), originator.alias("originator"),
        F.concat(F.lit("room-"), F.col("user_id") % GROUPS).alias("group_id"), F.concat_ws("/", originator, F.to_date("ts")).alias("session_id"),
        F.when(failed, "map_delete").otherwise("map_set").alias("op"), F.get_json_object("props", "$.k").alias("key"), "value",
        (F.round(F.col("value") * 100).cast("long") * F.when(failed, -1).otherwise(1)).alias("delta"), "event_type", "ts")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "events"))


LOG_SQL = f"""e AS (SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) * 1000 AS hlc, 'u' || user_id AS originator,
 'room-' || (user_id % {GROUPS}) AS group_id, 'u' || user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
 CASE WHEN event_type = 'error' THEN 'map_delete' ELSE 'map_set' END AS op, json_extract_string(props, '$.k') AS key, value,
 CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS delta, event_type, ts FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as edits of one text a conversation: (conv_id, turn, op, arg, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
