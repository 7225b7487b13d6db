"""Contiguous shards of nearly equal bytes, by global prefix sums.

The table is put in the order (id, size, checksum), dealt into range blocks; each block's total is
summed, the totals (one row a block) are accumulated, and a running sum inside each block added to
what lies before the block gives every row its global byte position. Equal targets cut that line:
a row belongs to the shard that holds its middle byte, so that a shard differs from the target by
less than the two rows at its ends. Only (id, size, checksum) is shuffled, never a text.

Cases: a null text has size 8 and the checksum of an empty text; a null id sorts first; repeated rows each
get a place of their own; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ordered_blocks, text_of

#: Bytes that a row counts besides those of its text.
ROW_BYTES = 8


def shard_by_bytes(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for each row of ``df``.

    shard: 0 to n_shards - 1, contiguous in the order of the ids; slot: place in the shard, gapless from 0.
    law is "bytes"; grown_shard (the shard, were there one more) is kept by another law only, so it is null.
    """
    scratch = Scratch(df.sparkSession)
    text = text_of(df[text_col])
    rows = df.select(
        df[id_col].alias("_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    keys = ["_id", "size", "text_crc32", "_tie"]
    rows = ordered_blocks(rows, keys, scratch)
    whole = Window.orderBy("_block")  # one row a block
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).select(
        "_block",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("b").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_block").orderBy(*(F.col(k).asc_nulls_first() for k in keys))
    # broadcast: as many rows as range blocks, four for each shuffle partition
    placed = rows.join(F.broadcast(totals), "_block").select(
        "_id", "size", "text_crc32",
        (F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"),
        "_total",
    ).withColumn("shard", F.floor((2 * F.col("_start") + F.col("size")) * n_shards / (2 * F.col("_total"))).cast("int"))
    placed = placed.withColumn("shard", F.least("shard", F.lit(n_shards - 1)))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    # broadcast: n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
