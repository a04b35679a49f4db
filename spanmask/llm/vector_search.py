"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean vector and scaled to length 1, is rotated by a fixed random
rotation and kept as the signs of its coordinates (packed bits) with two scalars: its
length and the inner product of the sign vector with it.  From bits and scalars follow an
unbiased estimate of the inner product with a query and a bound on its error; only vectors
whose distance may, within ``BOUND`` standard errors, be among the nearest so far are
compared exactly, in double precision.

Queries are a stated set against all rows: they are taken in slices of at most
``SLICE_BYTES`` (one slice unless there are very many), each broadcast in turn; every task
keeps the nearest of its own rows per query, and a window merges the tasks' answers.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
those of another length than the most frequent one (ties: the longer).  Rows with equal ids
and vectors count once; of equal vectors only the lowest ids can be among the nearest, so a
task reranks each once.  Null ids take no part.  Empty tables give empty results.
Only the id and the vector column are read; other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUND = 4.0
SLICE_BYTES = 16 << 20
SEED = 7
_QUERIES_AT_ONCE = 64
_PAIRS_AT_ONCE = 1 << 16


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _mean(vectors: DataFrame, dim: int) -> np.ndarray:
    def add(batches):
        n, total = 0, np.zeros(dim)
        for b in batches:
            x = _matrix(b.column("v"), dim)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    sums = vectors.select("v").mapInArrow(add, "n long, s array<double>")
    row = sums.agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim))).first()
    return np.array([row[f"s{i}"] for i in range(dim)]) / max(1, row["n"] or 0) if row["n"] else np.zeros(dim)


def encode(vectors: DataFrame, dim: int, mean: np.ndarray) -> DataFrame:
    """(id, v) with ``code`` (packed signs), ``norm`` and ``fit`` (inner product of the signs'
    unit vector with the rotated unit vector)."""
    rotation = _rotation(dim)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim) - mean
            norm = np.linalg.norm(x, axis=1)
            y = (x / np.where(norm > 0, norm, 1)[:, None]) @ rotation
            code = np.packbits(y > 0, axis=1, bitorder="little")
            fit = np.where(norm > 0, np.abs(y).sum(axis=1) / np.sqrt(dim), 1.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(fit)], ["id", "v", "code", "norm", "fit"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, code binary, norm double, fit double")


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, squares added in the order of the components."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        d = x[:, i] - q[:, i]
        total += d * d
    return np.sqrt(total)


class _Nearest:
    """The k nearest (distance, id) of each of a slice's queries among the rows seen so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, mean: np.ndarray, k: int):
        self.ids, self.q, self.k, self.dim = ids, q, k, q.shape[1]
        r = q - mean
        self.norm = np.linalg.norm(r, axis=1)
        self.rotated = ((r / np.where(self.norm > 0, self.norm, 1)[:, None]) @ _rotation(self.dim)).astype(np.float32)
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def add(self, ids, x, code, norm, fit):
        sign = np.unpackbits(code, axis=1, bitorder="little")[:, : self.dim].astype(np.float32) * 2 - 1
        sign /= np.sqrt(self.dim)
        slack = BOUND * np.sqrt(np.maximum(0, 1 - fit * fit) / (fit * fit * max(1, self.dim - 1))) + 1e-5
        for lo in range(0, len(self.ids), _QUERIES_AT_ONCE):
            hi = min(lo + _QUERIES_AT_ONCE, len(self.ids))
            inner = (self.rotated[lo:hi] @ sign.T) / fit
            both = 2 * self.norm[lo:hi, None] * norm
            square = self.norm[lo:hi, None] ** 2 + norm**2
            for i in range(lo, hi):
                estimate = square[i - lo] - both[i - lo] * inner[i - lo]
                at_least = estimate - both[i - lo] * slack
                few = min(len(ids), 2 * self.k)
                self._rerank(i, np.argpartition(estimate, few - 1)[:few], ids, x)
                d = self.found[i][0]
                near = np.flatnonzero(at_least <= d[-1] ** 2 * (1 + 1e-9)) if len(d) == self.k else np.arange(len(ids))
                for s in range(0, len(near), _PAIRS_AT_ONCE):
                    self._rerank(i, near[s : s + _PAIRS_AT_ONCE], ids, x)

    def _rerank(self, i: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        rows = rows[ids[rows] != self.ids[i]]
        if not len(rows):
            return
        d = np.concatenate([self.found[i][0], _distances(x[rows], np.broadcast_to(self.q[i], (len(rows), self.dim)))])
        j = np.concatenate([self.found[i][1], ids[rows]])
        order = np.lexsort((d, j))  # an id seen twice counts with its smallest distance
        d, j = d[order], j[order]
        once = np.concatenate([[True], j[1:] != j[:-1]])
        d, j = d[once], j[once]
        best = np.lexsort((j, d))[: self.k]
        self.found[i] = d[best], j[best]

    def rows(self) -> pa.RecordBatch:
        size = [len(d) for d, _ in self.found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, size)), pa.array(np.concatenate([j for _, j in self.found] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([d for d, _ in self.found] or [np.zeros(0)]))], ["query_id", "vec_id", "score"])


def _lowest_ids(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k + 1 rows of lower ids and the same vector precede."""
    row = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, group = np.unique(row, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    again = np.concatenate([[False], (g[1:] == g[:-1]) & (i[1:] == i[:-1])])
    order, g = order[~again], g[~again]
    first = np.concatenate([[True], g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return order[rank <= k]


def search(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query`` its k nearest other rows."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("is_query"))
    v = v.where(F.col("id").isNotNull() & usable(F.col("v")))
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None or not dims["q"]:
        return empty
    dim, v = dims["d"], v.where(F.size("v") == dims["d"])
    mean = _mean(v, dim)
    index, queries = encode(v, dim, mean), v.where("is_query").select("id", "v").distinct()
    slices = -(-dims["q"] * dim * 8 // slice_bytes)
    parts = None
    for s in range(slices):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == s).toArrow().combine_chunks()
        if mine.num_rows:
            ids = mine.column("id").to_numpy()
            q = _matrix(mine.column("v").combine_chunks(), dim)
            order = np.lexsort((*q.T[::-1], ids))
            part = _slice_search(index, ids[order], q[order], mean, k)
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return empty
    best = parts.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _slice_search(index: DataFrame, ids: np.ndarray, q: np.ndarray, mean: np.ndarray, k: int) -> DataFrame:
    shared, dim = index.sparkSession.sparkContext.broadcast((ids, q)), q.shape[1]

    def run(batches):
        near = _Nearest(*shared.value, mean, k)
        for b in batches:
            if b.num_rows:
                i, x = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
                keep = _lowest_ids(i, x, k)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(i), -1)
                near.add(i[keep], x[keep], code[keep], b.column("norm").to_numpy()[keep], b.column("fit").to_numpy()[keep])
        yield near.rows()

    return index.mapInArrow(run, "query_id long, vec_id long, score double")
