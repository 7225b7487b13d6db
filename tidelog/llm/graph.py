"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with v < u.

    Large-star ties every greater neighbour of a node to the least of its neighbourhood, small-star every
    smaller neighbour and the node itself. Minima are aggregated where the edges are read; the join that
    hands them back is one that Spark may split for a node with many neighbours.
    """
    both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
    return small.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): v is the least node of u's component, for every node u that is not the least itself.

    edges: two columns u, v of node numbers, in any direction, repeated or not; loops and nulls say nothing.
    Each round is written and read again; rounds go on until the edges are stars that no longer change.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.save(edges, narrow=True)
    mark = _mark(edges)
    while mark[0]:
        after = scratch.save(star_round(edges), narrow=True)
        scratch.drop(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges
