"""Nearest neighbours by randomly rotated one-bit codes with error bounds, then exact reranking.

Every vector is scaled to length 1, rotated by a fixed random orthogonal matrix and stored as its signs (packed
bits) with one correction scalar, its inner product with its code. For a query the inner product with a
vector is estimated from the bits and the scalar; the estimate's error is bounded with high probability.
Only vectors whose upper bound reaches the k-th best exact score so far are reranked on the original
components in double precision. Every row is indexed; there is no cap on candidates.

Queries go to the executors in waves of a fixed number, each written before the next begins and its broadcast destroyed,
so that neither what is broadcast nor what the driver holds grows with the input.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors of another length than the query have no cosine with it and are left out; repeated
rows are candidates of their own, and queries of their own: each row that is a query is answered, with the other rows
of its id among its candidates; rows with a null id take no part; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch

#: Queries broadcast at once (times components times 8 bytes: 32 MB for 64 components).
WAVE = 65_536
#: Width of the error bound in standard deviations.
SIGMAS = 3.0
#: Candidates scored at once, and queries estimated at once.
ROWS, QUERIES = 2048, 512


def rotation(d: int) -> np.ndarray:
    """The same random orthogonal d x d matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_517 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and their inner products with the codes."""
    turned = x @ turn
    bits = turned > 0
    return np.packbits(bits, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated unit queries with coded vectors, and the bound's half width."""
    d = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    est = (queries.astype(np.float32) @ signs.T) / scalars.astype(np.float32)
    return est, (SIGMAS * np.sqrt(np.maximum(1 - scalars**2, 0)) / (scalars * np.sqrt(max(d - 1, 1))) + 1e-4).astype(np.float32)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the same order for equal vectors."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


class _Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        few = place < self.k
        rows, ids, scores, place = rows[few], ids[few], scores[few], place[few]
        own = np.unique(rows)
        at = np.searchsorted(own, rows)
        s = np.hstack([self.score[own], np.full((len(own), self.k), -np.inf)])
        i = np.hstack([self.ids[own], np.full((len(own), self.k), np.iinfo(np.int64).max)])
        s[at, self.k + place], i[at, self.k + place] = scores, ids
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[own], self.ids[own] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def _search(best: _Best, q_rows: np.ndarray, c_rows: np.ndarray, q: np.ndarray, turned: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scalars: np.ndarray, k: int) -> None:
    for a in range(0, len(q), QUERIES):
        est, width = estimate(turned[a : a + QUERIES], codes, scalars)
        own = q_rows[a : a + QUERIES, None] == c_rows[None, :]
        bar = best.score[a : a + QUERIES, k - 1].copy()
        fresh = bar == -np.inf
        if fresh.any():  # the k-th greatest lower bound is a bar that nothing better falls below
            low = np.where(own[fresh], -np.inf, est[fresh] - width)
            bar[fresh] = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else -np.inf
        r, c = np.nonzero((est + width >= bar[:, None]) & ~own)
        for at in range(0, len(r), 1 << 17):
            rr, cc = r[at : at + (1 << 17)] + a, c[at : at + (1 << 17)]
            best.add(rr, ids[cc], cosines(q[rr], x[cc]))


def _matrix(column) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def usable(vector: Column) -> Column:
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good) & F.exists(vector, lambda c: c != 0)


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, row, v, code, scalar) of each usable row; row numbers the rows of ``df``."""
    def coded(batches):
        for pdf in batches:
            for d, part in pdf.groupby(pdf["v"].map(len)):
                x = _matrix(part["v"])
                codes, scalars = encode(x / np.sqrt((x * x).sum(axis=1))[:, None], rotation(d))
                yield part.assign(code=[c.tobytes() for c in codes], scalar=scalars)

    rows = df.select(df[id_col].cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), df[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.mapInPandas(coded, "id long, row long, v array<double>, code binary, scalar double")


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row of ``df`` for which ``is_query`` (of ``id``) holds."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    coded = scratch.save(index(df, id_col, vector_col))
    queries = coded.filter(is_query).select("row", "id", "v")
    waves = max(1, -(-queries.count() // wave))
    found = []
    for w in range(waves):
        # at most about ``wave`` rows, dealt by a hash of the row
        got = queries.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == w).toPandas().sort_values(["id", "row"], kind="stable")
        by_d = {d: (part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64), _matrix(part["v"])) for d, part in got.groupby(got["v"].map(len))}
        sent = spark.sparkContext.broadcast(by_d)

        def nearest(batches, sent=sent):
            import pandas as pd

            best = {}
            for pdf in batches:
                for d, part in pdf.groupby(pdf["v"].map(len)):
                    if d not in sent.value:
                        continue
                    q_rows, _, q = sent.value[d]
                    if d not in best:
                        best[d] = (_Best(len(q_rows), k), (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ rotation(d))
                    rows, ids, x = part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64), _matrix(part["v"])
                    codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(ids), -1)
                    for a in range(0, len(ids), ROWS):
                        s = slice(a, a + ROWS)
                        _search(best[d][0], q_rows, rows[s], q, best[d][1], ids[s], x[s], codes[s], part["scalar"].to_numpy()[s], k)
            for d, (b, _) in best.items():
                r, c = np.nonzero(b.score > -np.inf)
                yield pd.DataFrame({"query": sent.value[d][0][r], "query_id": sent.value[d][1][r], "vec_id": b.ids[r, c], "score": b.score[r, c]})

        part = coded.mapInPandas(nearest, "query long, query_id long, vec_id long, score double")
        by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found.append(scratch.save(part.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
        sent.destroy()
    scratch.keep_only(*found)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
