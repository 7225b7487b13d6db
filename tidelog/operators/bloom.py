"""Bloom filters over a column, with double hashing by the halves of a 128-bit FNV-1a digest."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The FNV-1a constants for 128 bits.
FNV_OFFSET, FNV_PRIME = 0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B
_MASK128, _MASK64 = (1 << 128) - 1, (1 << 64) - 1


def size_for(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n items at false-positive rate p."""
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return max(bits, 64), max(1, math.floor(bits / n * math.log(2) + 0.5))


def halves(data: bytes) -> tuple[int, int]:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & _MASK128
    return struct.unpack("<QQ", h.to_bytes(16, "big"))


def indexes(data: bytes, bits: int, k: int) -> list[int]:
    a, b = halves(data)
    return [((a + i * b) & _MASK64) % bits for i in range(k)]


def _places(bits: int, k: int):
    def places(s):
        return s.map(lambda x: None if x is None else indexes(x.encode(), bits, k))

    return F.pandas_udf(places, "array<bigint>")


def build(items: DataFrame, column: str, bits: int, k: int) -> DataFrame:
    """The filter as rows (word, value) of its non-zero 64-bit words: OR-ed where the items are read, so mergeable."""
    at = items.filter(F.col(column).isNotNull()).select(F.explode(_places(bits, k)(F.col(column).cast("string"))).alias("at"))
    bit = F.get(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("value"))


def merge(*filters: DataFrame) -> DataFrame:
    union = filters[0]
    for f in filters[1:]:
        union = union.unionByName(f)
    return union.groupBy("word").agg(F.bit_or("value").alias("value"))


def contains(items: DataFrame, column: str, words: DataFrame, bits: int, k: int) -> DataFrame:
    """``items`` with ``maybe``: whether all bits of the item are set; false for a null, which is never put in."""
    at = items.withColumn("_item", F.monotonically_increasing_id()).withColumn("_at", F.explode_outer(_places(bits, k)(F.col(column).cast("string"))))
    at = at.withColumn("word", F.floor(F.col("_at") / 64)).join(words, "word", "left")
    bit = F.get(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))), (F.col("_at") % 64).cast("int"))
    return at.groupBy("_item", *items.columns).agg(F.bool_and(F.coalesce(F.col("value").bitwiseAND(bit) != 0, F.lit(False))).alias("maybe")).drop("_item")


def estimate(words: DataFrame, bits: int, k: int) -> DataFrame:
    """Items that the set bits speak for, and the rate of false positives at that number."""
    n = -(bits / k) * F.log(1 - F.sum(F.bit_count("value")) / bits)
    return words.agg(n.alias("items")).withColumn("false_positive_rate", F.pow(1 - F.exp(-k * F.col("items") / bits), F.lit(k)))


def count(items: DataFrame, column: str) -> DataFrame:
    """Items put in, repeated ones counted."""
    return items.agg(F.count(column).alias("items"))


def serialize(words: dict[int, int], bits: int, k: int) -> bytes:
    """Little-endian k, bits and number of words, then the words."""
    n = -(-bits // 64)
    return struct.pack(f"<QQQ{n}Q", k, bits, n, *(words.get(i, 0) & _MASK64 for i in range(n)))


def deserialize(data: bytes) -> tuple[dict[int, int], int, int]:
    if len(data) < 24:
        raise ValueError("a filter has 24 bytes at least")
    k, bits, n = struct.unpack_from("<QQQ", data)
    if len(data) < 24 + 8 * n:
        raise ValueError("the filter is cut off")
    return dict(enumerate(struct.unpack_from(f"<{n}Q", data, 24))), bits, k
