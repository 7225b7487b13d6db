"""Helpers shared by the corpus operators: shared scratch tables, global order, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir of the session.

    Where it is unset (single-machine sessions such as tests) a folder of this machine is
    taken; on any other master that is an error, since executors could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tidelog-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of an Arrow batch, where the session has the default of 64 MB: a Python worker holds a few times as much.
BATCH_BYTES = 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold at once, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None):
    """The session with ``key`` set to ``value`` for a while; None leaves it alone."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables written once and read again, so that lineage is cut and lost executors cost nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        lean_batches(spark)
        self.saved: list[DataFrame] = []
        self.root = f"{scratch_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """Writes ``df`` and reads it again. narrow: its shuffles are dealt by size alone, so that a small table makes one
        file instead of one for each core. The shuffle files of ``df`` go once it is written, not when the driver collects its garbage."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        with setting(self.spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false" if narrow else None), setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        self.saved = [d for d in self.saved if d is not df]
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def keep_only(self, *kept: DataFrame) -> None:
        for df in [d for d in self.saved if not any(d is k for k in kept)]:
            self.drop(df)


def text_of(column: str | Column) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_blocks(df: DataFrame, keys: list[str], scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """``df`` (narrow) dealt by ranges of ``keys`` into blocks, saved with the block's number ``_block``.

    The keys must break all ties, so that no range is larger than its share; nulls come first.
    The saved table fixes the ranges: totals by block and the rows of a block always agree.
    """
    blocks = blocks or 4 * shuffle_partitions(df.sparkSession)
    order = [F.col(k).asc_nulls_first() for k in keys]
    return scratch.save(df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
