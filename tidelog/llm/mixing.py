"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target; a document is taken floor(target / source size) times for certain, and once
more with the probability left over. Those probabilities are rounded by the cube method: undecided documents are moved
along a direction that keeps both their words and their number (the null space of the two constraints) until one is
decided. A document that holds a good part of the undecided words, and each of the last ones, is moved against all
others at once (its projection on the null space), the longest first, so that the many short ones make good for it; the
rest move three at a time. This flight runs in blocks of about BLOCK documents; each leaves two or three undecided, the
shortest as far as possible, which meet in a next, much smaller round, until one block a source is left. It flies until
LAST documents are undecided; the landing drops the number of documents and draws a subset of them, by its probability
among those whose words come nearest to what is left (see ``landing``).

Cases: a null text or one without words has size 0 and is never taken; a null source is a source of its own, the last;
repeated rows are documents of their own; texts of any length count whole; ids of any type come back as they are; an empty
table gives an empty table; further columns are ignored, in ``apply_mix`` they stay. Reruns agree, as all chance is drawn
from ids and sizes; only where rows share id and size does the order of the rows take part.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, free_name, n_words, text_of

WEIGHTS = (5, 2, 1)
#: No document is taken more often, and so no source exceeds this many times its size.
MOST = 3
BLOCK = 4096
EPS = 1e-9
#: Documents that the landing decides; those at the end of a flight that move against all others, and the share of the
#: undecided words from which a longer document does.
LAST, CLOSE, SHARE = 16, 256, 0.01


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target): a row a source, from a table of (source, size).

    All words are shared by the weights; what exceeds ``most`` times a source's size is shared again among the
    others, until none exceeds. As source i is full for levels over most * size / weight, one pass over the
    sources in the order of that bound finds the level.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    at = (F.row_number().over(everything) - 1) % len(weights)
    src = src.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), at)).withColumn("full", (F.col("source_size") * most).cast("double"))
    by_bound = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") <= F.col("full") / F.col("w"), F.col("level"))).over(whole)
    return src.select("source", "source_size", "n", F.least("full", F.coalesce(level * F.col("w"), F.col("full"))).alias("target"))


def _step(x: np.ndarray, v: np.ndarray, rng: random.Random) -> np.ndarray:
    """x moved along v, up or down by chance so that its mean stays, until a component is 0 or 1."""
    moved = np.abs(v) > EPS
    room = lambda w: np.where(w > 0, 1 - x[moved], x[moved]) / np.abs(w)
    ups, downs = room(v[moved]), room(-v[moved])
    up, down = ups.min(), downs.min()
    rise = rng.random() * (up + down) < down
    x = x + v * (up if rise else -down)
    at = np.flatnonzero(moved)[(ups if rise else downs).argmin()]
    x[at] = round(float(x[at]))
    return np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))


def _against_all(size: np.ndarray, rng: random.Random) -> np.ndarray:
    """The first of the documents moved against the others, each by a weight of chance: its projection on the null
    space of number and words, in the metric of the weights. Where these leave it no move, words alone are kept.
    """
    w = np.array([1.0, *(0.5 + rng.random() for _ in size[1:])])
    for a in (np.stack([np.ones(len(size)), size / size.mean()]), size[None, :] / size.mean()):
        gram = (a * w) @ a.T
        if np.linalg.cond(gram) < 1e10:
            v = -w * (np.linalg.solve(gram, a[:, 0]) @ a)
            v[0] += 1
            if v[0] > 1e-6:
                return v / v[0]
    return np.eye(1, len(size))[0]


def _by_threes(x: list[float], size: list[float], keep: int, rng: random.Random) -> list[float]:
    """Moves three at a time until ``keep`` are undecided."""
    waiting = [i for i, p in enumerate(x) if 0 < p < 1]
    active, at = waiting[:3], 3
    while len(active) == 3 and len(waiting) - at + 3 > keep:
        a, b, c = active
        v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = min((1 - x[i]) / d if d > 0 else x[i] / -d for i, d in zip(active, v, strict=True) if d)
        down = min(x[i] / d if d > 0 else (1 - x[i]) / -d for i, d in zip(active, v, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for i, d in zip(active, v, strict=True):
            p = x[i] + step * d
            if EPS < p < 1 - EPS:
                x[i] = p
                still.append(i)
            else:
                x[i] = float(round(p))
        if len(still) == 3:  # no move left in floating point
            x[still[0]] = float(round(x[still[0]]))
            still = still[1:]
        while len(still) < 3 and at < len(waiting):
            still.append(waiting[at])
            at += 1
        active = still
    return x


def flight(pi: Sequence[float], size: Sequence[float], rng: random.Random, keep: int = 2) -> list[float]:
    """Moves all but ``keep`` probabilities to 0 or 1, keeping sum(pi) (as far as can be) and sum(pi * size).

    The longest documents come first.
    """
    x, size = np.array(pi, float), np.asarray(size, float)
    x = np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))
    live = np.flatnonzero((x > 0) & (x < 1))
    while len(live) > max(keep, 1):
        if len(live) > CLOSE and size[live[0]] <= SHARE * size[live].sum():
            x = np.array(_by_threes(x.tolist(), size.tolist(), CLOSE, rng))
        else:
            x[live] = _step(x[live], _against_all(size[live], rng), rng)
        live = live[(x[live] > 0) & (x[live] < 1)]
    return x.tolist()


def landing(pi: Sequence[float], size: Sequence[float], rng: random.Random, words: float) -> list[float]:
    """Decides the few that the flight left: a subset that brings the taken words as near to ``words`` as can be.

    Subsets are as near where they are off by half the shortest document at most; of these one is drawn by its
    probability (each document in by its own), so that inclusion stays close to pi. Else the nearest is taken, and if it
    is off by more than the shortest document of all (a document of a good part of the words had to be rounded),
    decided documents change over, the longest first, then any of the LAST shortest, where that brings the words nearer.
    """
    x, size = np.array(pi, float), np.asarray(size, float)
    left = np.flatnonzero((x > 0) & (x < 1))
    if len(left):
        p, s = x[left], size[left]
        chosen = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = np.abs(chosen @ s - p @ s)
        near = off <= max(off.min() + EPS, s.min() / 2)
        total = np.cumsum(np.where(near, np.exp(chosen @ np.log(p) + (1 - chosen) @ np.log(1 - p)), 0.0))
        x[left] = chosen[min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(chosen) - 1)] if total[-1] > 0 else chosen[off.argmin()]
    short = words - x @ size
    if len(x) and abs(short) > size.min():
        for i in np.argsort(-size, kind="stable"):
            change = size[i] if x[i] == 0 else -size[i]
            if abs(short - change) < abs(short):
                x[i] = 1 - x[i]
                short -= change
    if len(x) and abs(short) > size.min():  # then any subset of the shortest
        few = np.argsort(size, kind="stable")[:LAST]
        flips = (np.arange(1 << len(few))[:, None] >> np.arange(len(few))) & 1
        flip = flips[np.abs(flips @ np.where(x[few] == 0, size[few], -size[few]) - short).argmin()]
        x[few] = np.abs(x[few] - flip)
    return x.tolist()


def _round(df: DataFrame, last: bool) -> DataFrame:
    def block(pdf):
        # the longest first: what stays undecided is short
        pdf = pdf.sort_values(["size", "_mix", "_id", "_row"], ascending=[False, True, True, True], kind="stable")
        size = pdf["size"].astype(float).tolist()
        rng = random.Random(f"{pdf['_source'].iloc[0]}:{pdf['_block'].iloc[0]}:{len(size)}:{last}")
        words = float(pdf["pi"] @ pdf["size"])
        pi = flight(pdf["pi"].tolist(), size, rng, LAST if last else 2)
        pdf["pi"] = landing(pi, size, rng, words) if last else pi
        return pdf

    return df.groupBy("_source", "_block").applyInPandas(block, df.schema)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, row_col: str | None = None) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies) for each row of ``df``: copies is how often it is taken.

    row_col names a column of distinct numbers of the rows of ``df``; the result has it as _row.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(df.select(
        df[id_col].alias("_id"), df[source_col].cast("string").alias("source"), n_words(text_of(df[text_col])).alias("size"), (df[row_col] if row_col else F.monotonically_increasing_id()).alias("_row")))
    goals = scratch.save(targets(rows, weights, most), narrow=True)
    ratio = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 12)).otherwise(0.0)
    repeated = not rows.groupBy("_id", "size").count().filter("count > 1").isEmpty()
    each = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select(rows["*"], "source_size", "target", "n", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("pi"))
    undecided = each.filter("size > 0 AND pi > 0").select(
        "_row", F.col("_id").cast("string").alias("_id"), "size", "pi", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"),
        F.xxhash64("_id", "size", *(["_row"] if repeated else [])).alias("_mix"), F.ceil(F.col("n") / BLOCK).alias("_blocks"))
    undecided = undecided.withColumn("_block", F.pmod("_mix", "_blocks"))
    most_blocks, done = goals.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0, []
    while most_blocks > 1:  # a round has about a thousandth of the rows of the one before
        flown = scratch.save(_round(undecided, last=False))
        done.append(flown.filter("pi <= 0 OR pi >= 1"))
        undecided = flown.filter("pi > 0 AND pi < 1").withColumn("_blocks", F.ceil(F.col("_blocks") * 3 / BLOCK)).withColumn("_block", F.pmod("_mix", "_blocks"))
        most_blocks = -(-most_blocks * 3 // BLOCK)
    done.append(_round(undecided, last=True))
    more = done[0]
    for d in done[1:]:
        more = more.unionByName(d)
    more = scratch.save(more.filter("pi >= 1").select(F.col("_row").alias("_taken")), narrow=True)
    out = each.join(more, F.col("_row") == F.col("_taken"), "left").withColumn("copies", F.col("whole") + F.col("_taken").isNotNull().cast("long"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0).cast("long")))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["_row"] if row_col else []))


def apply_mix(df: DataFrame, **kwargs) -> DataFrame:
    """``df`` with each row as often as the mix takes it; columns and their values stay as they are."""
    row = free_name(df, "_row")
    rows = Scratch(df.sparkSession).save(df.withColumn(row, F.monotonically_increasing_id()))
    times = free_name(df, "_times")
    copies = mix(rows, row_col=row, **kwargs).filter("copies > 0").select(F.col("_row").alias(row), F.col("copies").alias(times))
    return rows.join(copies, row).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*df.columns)
