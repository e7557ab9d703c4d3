"""Approximate nearest neighbours by collision counting over query-centred windows."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

RESULT = "query_id long, vec_id long, score double"


def projections(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """Random directions, one column each, the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Cosines in double precision; each by the same operations whatever its place, so that ties stay ties."""
    return (rows * query).sum(axis=1) / (norms * norm)


class Block:
    """The vectors of one block behind a sorted array of every projection of their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.axes = projections(vectors.shape[1], count)
        placed = ((vectors / self.norms[:, None]) @ self.axes).T
        self.order = np.argsort(placed, axis=1, kind="stable")
        self.values = np.take_along_axis(placed, self.order, axis=1)

    def windows(self, queries: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, array and half-width: where the window around the query begins and ends."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        centers = (queries / norms[:, None]) @ self.axes
        shape = (len(queries), len(self.order), len(halves))
        begin, end = np.empty(shape, dtype=np.int64), np.empty(shape, dtype=np.int64)
        for j, values in enumerate(self.values):
            begin[:, j] = np.searchsorted(values, centers[:, j, None] - halves)
            end[:, j] = np.searchsorted(values, centers[:, j, None] + halves, side="right")
        return begin, end

    def nearest(self, query_id: int, query: np.ndarray, begin: np.ndarray, end: np.ndarray, halves: np.ndarray, k: int, share: float, sure: float):
        """Ids and cosines of the ``k`` nearest among the vectors whose collisions pass the threshold.

        A vector collides once for each array in whose window it lies. Windows widen from one
        half-width to the next, and only their new parts are counted. A vector that collides in ``share``
        of the arrays is verified by its cosine. The search ends when the k-th nearest verified vector
        is so near that one like it would by now collide in ``sure`` of the arrays, more than ``share``, so
        that few of its like can have been missed; or when the windows hold everything.
        """
        norm = float(np.sqrt((query * query).sum()))
        m, n = self.order.shape
        counts = np.zeros(n, dtype=np.int64)
        threshold = share * m
        verified = np.zeros(n, dtype=bool)
        at, found = np.zeros(0, dtype=np.int64), np.zeros(0)
        for level, half in enumerate(halves):
            low, high = begin[:, level], end[:, level]
            if level:
                parts = [order[a:b] for order, a, b in zip(self.order, low, begin[:, level - 1], strict=True) if a < b]
                parts += [order[a:b] for order, a, b in zip(self.order, end[:, level - 1], high, strict=True) if a < b]
            else:
                parts = [order[a:b] for order, a, b in zip(self.order, low, high, strict=True)]
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= threshold) & ~verified)
            if len(new):
                verified[new] = True
                new = new[self.ids[new] != query_id]
                at = np.concatenate((at, new))
                found = np.concatenate((found, cosines(self.vectors[new], self.norms[new], query, norm)))
                if len(found) > k:  # ties with the last are kept, to be told apart by id
                    near = found >= np.partition(found, len(found) - k)[len(found) - k]
                    at, found = at[near], found[near]
            if len(found) >= k and np.sort(found)[-k] >= 1 - (half / quantile(sure)) ** 2 / 2:
                break
        best = np.lexsort((self.ids[at], -found))[:k]
        return self.ids[at[best]], found[best]

    def search(self, query_ids: list[int], queries: np.ndarray, k: int, share: float, sure: float, first: float, growth: float):
        """(query_id, ids, cosines) of each query. A last window, wider than any difference, holds all."""
        reach = 2 * float(np.sqrt((self.axes * self.axes).sum(axis=0)).max()) + 1
        steps = int(np.ceil(np.log(reach / first) / np.log(growth)))
        halves = np.append(first * growth ** np.arange(steps), reach)
        for begin in range(0, len(queries), 128):
            some = queries[begin : begin + 128]
            low, high = self.windows(some, halves)
            for i, query in enumerate(some):
                query_id = query_ids[begin + i]
                yield query_id, *self.nearest(query_id, query, low[i], high[i], halves, k, share, sure)


def quantile(share: float) -> float:
    """z with P(|Z| <= z) = share for a standard normal Z."""
    return NormalDist().inv_cdf((1 + share) / 2)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & nonzero).withColumn("dim", F.size("v"))


def search(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    count: int = 64,
    share: float = 0.7,
    sure: float = 0.78,
    first: float = 0.3,
    growth: float = 1.25,
    block: int = 16384,
    queries: int = 16384,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first.

    Queries are the rows whose id is divisible by ``every``; every row but the query's own is a candidate.
    Nearness is the cosine in double precision, ties go to the smaller id.

    Vectors are dealt by a hash of the id into blocks of about ``block`` rows and queries into blocks of
    about ``queries``; a task gets one block of each, builds ``count`` sorted arrays and widens windows in
    them (see ``Block.nearest``). Every block answers with its own nearest, so what is ranked
    at the end are k rows a query and block. Nothing is broadcast, copies of one vector spread over all
    blocks, and a task's memory is that of its two blocks.

    Defined cases: vectors that are null, zero, or hold null or non-finite components, and null ids, take no
    part; only vectors of the same length are compared; rows repeated with the same id count once; an id
    with different vectors is searched for each and may be found once for each; with fewer
    candidates than k all are returned; other columns are ignored.
    """
    rows = usable(vectors, vec_id, embedding).distinct()
    total = rows.count()
    parts, asked = max(1, -(-total // block)), max(1, -(-total // every // queries))
    hashed = F.xxhash64("vec_id")
    here = rows.select("dim", F.pmod(hashed, F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("ask"), "vec_id", "v")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    wanted = rows.where(F.col("vec_id") % every == 0).select("dim", everywhere, F.pmod(hashed, F.lit(asked)).cast("int").alias("ask"), "vec_id", "v")

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if mine.num_rows and theirs.num_rows:
            dim = mine["dim"][0].as_py()
            stacked = [np.asarray(t["v"].combine_chunks().flatten()).reshape(-1, dim) for t in (mine, theirs)]
            place = np.argsort(mine["vec_id"].to_numpy(), kind="stable")
            held = Block(mine["vec_id"].to_numpy()[place], stacked[0][place], count)
            for query_id, ids, scores in held.search(theirs["vec_id"].to_pylist(), stacked[1], k, share, sure, first, growth):
                out[0].extend([query_id] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(scores.tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["dim", "part", "ask"]
    found = here.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, RESULT)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
