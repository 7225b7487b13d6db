"""The states of a log that grows: streaming aggregates whose result is that of the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog import fixtures
from tidelog.operators import crdt, sync
from tidelog.sources.shared import folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = fixtures.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def materialise(stream: DataFrame, keys: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """Runs a stream to its present end and gives its result table.

    Every batch is written to a table in a shared folder, and one that is done again replaces itself; the
    checkpoint is beside it, so a run with the same ``root`` goes on where the last ended. Without keys the batches are whole
    results and the newest counts; with keys they are changes, and each key's newest row counts.
    """
    spark, root = stream.sparkSession, root or folder(stream.sparkSession)
    query = (stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/out")
    if not keys:
        return out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("_v"))
    return newest.select(*keys, "_v.*").select(*stream.columns)


def lww_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones stay in the state, so a late older write does not bring a key back."""
    return materialise(crdt.lww_map(fixtures.as_log(read_table(spark, sf_dir, "events"))))


def version_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(sync.version_vector(fixtures.as_log(read_table(spark, sf_dir, "events"))))


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.as_log(read_table(spark, sf_dir, "events"))
    return materialise(log.groupBy("group_id").agg(F.sum("delta").alias("value")))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.as_log(read_table(spark, sf_dir, "events"))
    out = log.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return materialise(out).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's text, kept as state and edited by every batch's turns in order."""
    def edit(key, batches, state):
        import pandas as pd

        now, rows = state.get[0] if state.exists else "", pd.concat(list(batches))
        for turn, piece in rows.sort_values("turn")[["turn", "text"]].itertuples(index=False):
            at = int(turn) * 7 % (len(now) + 1)
            now = now[:at] + (piece or "") + now[at:]
        state.update((now,))
        yield pd.DataFrame({"conv_id": [key[0]], "text": [now]})

    stream = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = stream.groupBy("conv_id").applyInPandasWithState(edit, "conv_id long, text string", "text string", "update", "NoTimeout")
    return materialise(out, ("conv_id",))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board's subscription: each key that was set, once, however often its event arrives."""
    log = fixtures.as_log(read_table(spark, sf_dir, "events")).filter("op = 'map_set'")
    return materialise(log.groupBy("group_id", "key").agg(F.min("seq").alias("seq")), ("group_id", "key"))
