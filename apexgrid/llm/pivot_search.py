"""Exact top-k inner products by a pivot-distance index.

Method: with one more component that brings every vector to the same length M, the largest inner products with a query are its
nearest neighbours: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest pivot and their distance from
it, range-partitioned and sorted by (pivot, distance, id), and cut into blocks of ``BLOCK`` rows: annuli of a pivot with an
inner and an outer radius. A frequent vector merely fills several blocks.

A query's own block gives a first lower bound of its k-th score, hence a radius D around it. By the triangle inequality a
block (pivot p, radii r1..r2) can hold a better vector only if r1 - D <= |q - p| <= r2 + D. The annuli of each pivot are
expanded from the query's distance as far as that holds; only those blocks are read for the query. Each gives the
query at most k rows that reach its bound, and a window per query ranks them.

The result is exact: pivots (means of a documented sample of ``SAMPLE`` vectors, the only thing fitted) decide how many blocks are read,
not what is found. Scores are integers; products go through doubles only if no sum can leave their 53 bits.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of unequal length are compared over the
components both have (missing ones are 0); rows with a null id take no part; rows that share the query's id are not its
candidates, and such rows ask once; fewer than k candidates give fewer rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.llm.columns import prepare
from apexgrid.session import materialised

K = 10
PIVOTS = 32
SAMPLE = 4096
BLOCK = 1024
#: queries that a task multiplies with a block at once, and rows per copy of a block
TOGETHER = 512
QUERIES_PER_COPY = 8192
SCALE = 1024

_KEYED = "pivot int, distance double, vec_id bigint, vec binary"
_BLOCKS = "block bigint, pivot int, inner double, outer double, ids binary, vecs binary, asked array<bigint>, bounds array<bigint>"


def integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part."""
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.coalesce(finite, F.lit(False)) & F.col(vec_id).isNotNull()
    return vectors.filter(usable).select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def _fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` groups of the sample: a few rounds of assignment from rows far from each other."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen].copy()
    for _ in range(4):
        nearest = (((pivots**2).sum(axis=1)) - 2 * sample @ pivots.T).argmin(axis=1)
        for p in np.unique(nearest):
            pivots[p] = sample[nearest == p].mean(axis=0)
    return pivots


class Space:
    """The lengthened vectors: what distances are taken in."""

    def __init__(self, dims: int, longest: int, pivots: np.ndarray | None = None):
        self.dims, self.longest, self.pivots = dims, longest, pivots
        # products of whole numbers stay exact in doubles
        self.exact = longest < 1 << 52

    def lengthened(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        rest = np.sqrt(np.maximum(self.longest - (v**2).sum(axis=1), 0))
        return np.concatenate([v, rest[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (q.astype(float) @ x.astype(float).T).astype(np.int64)
        return q @ x.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, bound: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k best (ids, scores), ties to the smaller id, without the query's own id and what is under the bound."""
    fits = ids != own
    if bound is not None:
        fits &= scores >= bound
    at = np.flatnonzero(fits)
    if len(at) > 4 * k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[at], scores[at]


def _blocks(space: Space, every: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple[int, float, int, bytes]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            ids = np.array([r[2] for r in rows], np.int64)
            vecs = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), space.dims)
            asked = np.unique(ids[ids % every == 0])
            bounds = []
            for q in asked:
                i = int(np.flatnonzero(ids == q)[0])
                _, scores = _best(space.scores(vecs[i : i + 1], vecs)[0], ids, int(q), None, k)
                bounds.append(int(scores[-1]) if len(scores) == k else None)
            values = [number, rows[0][0], rows[0][1], rows[-1][1], ids.tobytes(), vecs.tobytes(), asked.tolist(), bounds]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            number += 1
            rows.clear()
            names = ["block", "pivot", "inner", "outer", "ids", "vecs", "asked", "bounds"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (len(rows) == BLOCK or rows[-1][0] != row[0]):
                    yield block()
                rows.append(row)
        if rows:
            yield block()

    return run


def _queries(space: Space, every: int):
    """Rows of a block to its queries: (query_id, bound, vec, distance from every pivot, reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "bound", "vec", "away", "reach"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
        for b in batches:
            for ids, vecs, asked, bounds in zip(*(c.to_pylist() for c in b.columns)):
                if not asked:
                    continue
                ids = np.frombuffer(ids, np.int64)
                vecs = np.frombuffer(vecs, np.int64).reshape(len(ids), space.dims)
                at = [int(np.flatnonzero(ids == q)[0]) for q in asked]
                q = vecs[at].astype(float)
                square = (q**2).sum(axis=1)
                points = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                away = space.distances(points)
                bound = np.array([np.nan if x is None else x for x in bounds], float)
                reach = np.sqrt(np.maximum(square + space.longest - 2 * bound, 0))
                # room for rounding
                reach = np.where(np.isnan(bound), np.inf, reach * (1 + 1e-9) + 1e-6 * np.sqrt(space.longest + 1))
                columns = [asked, bounds, [vecs[i].tobytes() for i in at], away.tolist(), reach.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _expand(space: Space, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vecs = None

        def answers(queries: list[tuple]) -> pa.RecordBatch:
            q = np.frombuffer(b"".join(r[4] for r in queries), np.int64).reshape(len(queries), space.dims)
            scores = space.scores(q, vecs)
            found = [(r[2], *_best(s, ids, r[2], r[3], k)) for r, s in zip(queries, scores)]
            n = [len(f[1]) for f in found]
            columns = [
                np.repeat(np.array([f[0] for f in found], np.int64), n),
                np.concatenate([f[1] for f in found]),
                np.concatenate([f[2] for f in found]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        waiting: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[2] is None:
                    if waiting:
                        yield answers(waiting)
                        waiting = []
                    ids = np.frombuffer(row[3 + 2], np.int64)
                    vecs = np.frombuffer(row[4], np.int64).reshape(len(ids), space.dims)
                else:
                    waiting.append(row)
                    if len(waiting) == TOGETHER:
                        yield answers(waiting)
                        waiting = []
        if waiting:
            yield answers(waiting)

    return run


def top_k(vectors: DataFrame, every: int, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each vector whose id is a multiple of ``every``."""
    spark = vectors.sparkSession
    prepare(spark)
    clean = integers(vectors, vec_id, embedding)
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    dims, longest = clean.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0))).first()
    space = Space(max(dims, 1), longest)
    picked = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    space.pivots = _fit_pivots(space.lengthened(_matrix(picked, space.dims)), PIVOTS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), space.dims)
            away = space.distances(space.lengthened(v))
            nearest = away.argmin(axis=1)
            columns = [
                pa.array(nearest, pa.int32()),
                pa.array(away[np.arange(len(v)), nearest]),
                b.column(0),
                pa.array([x.tobytes() for x in v], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "distance", "vec_id", "vec"])

    order = ["pivot", "distance", "vec_id"]
    ordered = clean.mapInArrow(keyed, _KEYED).repartitionByRange(*order).sortWithinPartitions(*order)
    index = materialised(ordered.mapInArrow(_blocks(space, every, k), _BLOCKS))
    asked = index.select("ids", "vecs", "asked", "bounds").mapInArrow(
        _queries(space, every), "query_id bigint, bound bigint, vec binary, away array<double>, reach double"
    )
    queries = materialised(asked.dropDuplicates(["query_id"]))
    copies = -(-queries.count() // QUERIES_PER_COPY)
    ways = queries.select("query_id", "reach", F.posexplode("away").alias("pivot", "away"))
    annuli = index.select("block", "pivot", "inner", "outer")
    near: Column = (F.col("inner") - F.col("reach") <= F.col("away")) & (F.col("away") <= F.col("outer") + F.col("reach"))
    copy = F.pmod(F.xxhash64("query_id"), F.lit(max(copies, 1)))
    hits = materialised(ways.join(annuli, "pivot").filter(near).select("block", "query_id", copy.alias("copy")))
    none = F.lit(None)
    asking = hits.join(queries, "query_id").select("block", "copy", "query_id", "bound", "vec", none.cast("binary").alias("ids"))
    data = hits.select("block", "copy").distinct().join(index, "block")
    data = data.select("block", "copy", none.cast("bigint").alias("query_id"), none.cast("bigint").alias("bound"), F.col("vecs").alias("vec"), "ids")
    together = data.unionByName(asking).repartition("block", "copy").sortWithinPartitions("block", "copy", F.col("query_id").asc_nulls_first())
    found = together.mapInArrow(_expand(space, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
