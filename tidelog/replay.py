"""python -m tidelog.replay --dir LOG [--after ID] [--limit N]: replays a log and prints each group's state."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.client import EventLog
from tidelog.operators import crdt, sync


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[tuple]:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--dir", required=True)
    args.add_argument("--after")
    args.add_argument("--limit", type=int)
    opts = args.parse_args(argv)
    spark = spark or SparkSession.builder.appName("replay").getOrCreate()
    log = EventLog(spark, opts.dir).scan(after_id=opts.after, limit=opts.limit)
    texts = crdt.text_fold(log.filter("op IN ('text_insert', 'text_delete')"), "group_id")
    vectors = sync.version_vector(log).groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("originator", "hlc")))).alias("versions"))
    out = vectors.join(texts, "group_id", "left").orderBy("group_id").select("group_id", "text", "versions")
    rows = [tuple(r) for r in out.toLocalIterator()]
    for group, text, versions in rows:
        print(f"{group}\t{text or ''}\t{versions}")
    return rows


if __name__ == "__main__":
    main()
