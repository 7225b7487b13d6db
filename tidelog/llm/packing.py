"""Best-fit packing of documents into bins of fixed length, with conflicts.

A bin holds at most one document of each source and one of each duplicate cluster. A document
longer than a bin fills bins of its own and sends the rest to be packed. Documents are dealt into packing groups
of about GROUP rows by a hash of id and row, so copies, rows of one id and a hot source spread evenly; each group is packed alone:
longest first, into the bin with the least residual that fits and carries neither its source's nor its
cluster's bit, found by searching upwards from the successor of its length.

Cases: a null text or one without words takes a place of length 0; a null source or cluster never conflicts;
repeated rows are documents of their own; ids of any type come back as they are; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, n_words, text_of

CAPACITY = 2048
GROUP = 4096
#: Room for the bins of a group in a bin's number.
BIN_BITS = 24


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; sources and clusters are bit numbers, -1 for none. Items in the order given.

    The open bins stand in the order of their residual, each with a bitmap of sources and one of clusters.
    """
    open_bins: list[tuple[int, int]] = []
    src_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        for at in range(bisect_left(open_bins, (size, -1)), len(open_bins)):
            residual, b = open_bins[at]
            if not (src_bits[b] & s or cluster_bits[b] & c):
                del open_bins[at]
                break
        else:
            residual, b = capacity, len(src_bits)
            src_bits.append(0)
            cluster_bits.append(0)
        src_bits[b] |= s
        cluster_bits[b] |= c
        out.append((b, capacity - residual))
        insort(open_bins, (residual - size, b))
    return out


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, words: Column | None = None) -> DataFrame:
    """A row for each piece of each document: id_col, n_tokens, piece, start, length, bin, position.

    start and length count words of the document; bin is unique over all, position the place in it.
    cluster: column of ``df`` that names a row's duplicate cluster; by default equal texts are one.
    words: column of ``df`` with the number of words of each row, for a ``df`` without texts; null is 0.
    """
    scratch = Scratch(df.sparkSession)
    if words is None:
        words = n_words(text_of(df[text_col]))
        cluster = F.when(df[text_col].isNotNull(), (F.xxhash64(df[text_col]) if cluster is None else cluster).cast("string"))
    rows = scratch.save(df.select(
        df[id_col].alias("_id"), df[source_col].cast("string").alias("source"), (F.lit(None) if cluster is None else cluster).cast("string").alias("cluster"), F.coalesce(words, F.lit(0)).cast("long").alias("n")).withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-rows.count() // GROUP))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_id", "n", "_row"), F.lit(groups)))

    def packed(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        order = pc.sort_indices(rows.append_column("_rest", pa.array(rest)), [("_rest", "descending"), ("_id", "ascending"), ("_row", "ascending")]).to_numpy()
        items = order[((rest > 0) | (n == 0))[order]]
        bits = lambda c: pc.fill_null(rows.column(c).combine_chunks().take(pa.array(items)).dictionary_encode().indices, -1).to_pylist()
        placed = best_fit(rest[items].tolist(), bits("source"), bits("cluster"), capacity)
        group = rows.column("_group")[0].as_py() << BIN_BITS
        long = np.repeat(order, full[order])  # the full bins of long documents
        piece = np.arange(len(long)) - np.repeat(np.cumsum(full[order]) - full[order], full[order])
        first = group + max((b for b, _ in placed), default=-1) + 1
        at = np.r_[items, long]
        columns = {
            "n_tokens": n[at], "piece": np.r_[full[items], piece], "start": np.r_[full[items], piece] * capacity, "length": np.r_[rest[items], np.full(len(long), capacity)],
            "bin": np.r_[np.array([group + b for b, _ in placed], dtype=np.int64), first + np.arange(len(long))], "position": np.r_[np.array([p for _, p in placed], dtype=np.int64), np.zeros(len(long), np.int64)]}
        return pa.table({"_id": rows.column("_id").take(pa.array(at)), **{k: pa.array(v.astype(np.int64)) for k, v in columns.items()}})

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.groupBy("_group").applyInArrow(packed, f"_id {kind}, n_tokens long, piece long, start long, length long, bin long, position long")
    return out.withColumnRenamed("_id", id_col)
