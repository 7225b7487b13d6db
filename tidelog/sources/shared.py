"""Folders that the driver and all executors see, and small files in them, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, read from the session; on one machine a folder of it will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tide-{uuid.uuid4().hex}"


class Files:
    """What a small-file store needs of a file system: any that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, name: str) -> list[str]:
        at = self._path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, name: str) -> int:
        at = self._path(f"{self.root}/{name}")
        return self.fs.getContentSummary(at).getLength() if self.fs.exists(at) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def read_text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", "true").text(f"{self.root}/{name}").collect())

    def write_text(self, name: str, text: str) -> None:
        """The whole file or the old one: a temporary file is renamed."""
        tmp = self._path(f"{self.root}/_{name}.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.delete(self._path(f"{self.root}/{name}"), False)
        self.fs.rename(tmp, self._path(f"{self.root}/{name}"))
