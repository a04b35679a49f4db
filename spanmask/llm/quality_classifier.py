"""Quality by nearest-neighbour voting in a latent semantic space.

At most ``TRAIN_ROWS`` labelled rows of each label give hashed n-gram vectors, whose leading
right singular vectors span the latent space; their latent vectors (a few megabytes, bounded
by the parameter) are broadcast.  Each document's cosine with every labelled vector is
computed in blocks, and its ``NEIGHBOURS`` nearest vote for their labels, weighted by
similarity and by the label's share of the sample.

Null or empty text and texts orthogonal to all neighbours: the labels' smoothed frequency
among learning rows, as is every score if nothing is labelled.  Repeated rows get equal
scores.  Empty tables give empty results.  A column of the input named like
the score is replaced, others but the text pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanmask.llm.blocks import pieces
from spanmask.llm.features import labelled_sample, ngrams

TRAIN_ROWS = 2048
NEIGHBOURS = 25
BITS = 10
DIMS = 48
_BLOCK = 256


def _vectors(column) -> np.ndarray:
    """Unit vectors of logarithmic counts, each family of n-grams in its own part."""
    n, families = ngrams(column, BITS)
    size = 1 << BITS
    out = np.zeros((n, len(families) * size), np.float32)
    for f, (h, bounds) in enumerate(families):
        row = np.repeat(np.arange(n), np.diff(bounds))
        counts = np.bincount(row * size + h.astype(np.int64), minlength=n * size).reshape(n, size)
        out[:, f * size : (f + 1) * size] = np.sqrt(counts.astype(np.float32) / np.maximum(1, np.diff(bounds))[:, None])
    return out


def _dense(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(lo, _BLOCK)
            v = _vectors(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()), part.column("label"), part.column("weight")], ["v", "label", "weight"])


class Model:
    def __init__(self, rows: pa.Table):
        """``rows``: v (float16 bytes), label, weight; in any order."""
        vectors, label = rows.column("v").to_pylist(), rows.column("label").to_pylist()
        order = sorted(range(len(label)), key=lambda i: (label[i], vectors[i]))
        self.y = np.array(label, np.float32)[order]
        self.w = rows.column("weight").to_numpy().astype(np.float32)[order]
        self.prior = float((self.y * self.w).sum() + 0.5) / (float(self.w.sum()) + 1.0)
        self.near = None
        if order:
            x = np.empty((len(order), len(vectors[0]) // 2), np.float32)
            for to, i in enumerate(order):
                x[to] = np.frombuffer(vectors[i], np.float16)
                vectors[i] = None
            self.mean = (self.w / self.w.sum()) @ x
            x -= self.mean
            self.basis = _leading(x, min(DIMS, len(order)))
            self.near = _unit(x @ self.basis)

    def score(self, column) -> np.ndarray:
        n = len(column)
        if self.near is None:
            return np.full(n, self.prior)
        v = _vectors(column)
        empty = ~v.any(axis=1)
        cos = _unit((v - self.mean) @ self.basis) @ self.near.T
        k = min(NEIGHBOURS, cos.shape[1])
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cos, top, axis=1), 0).astype(np.float64) ** 4
        vote *= self.w[top]
        total = vote.sum(axis=1)
        p = np.where(total > 0, (vote * self.y[top]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(np.where(empty, self.prior, p), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration from a fixed seed."""
    rng = np.random.default_rng(20)
    q = x.T @ rng.standard_normal((len(x), dims + 16), dtype=np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dims].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    # 2 * rows vectors at most
    return Model(labelled_sample(docs, labels, label, rows).mapInArrow(_dense, "v binary, label int, weight double").toArrow())


def score(df: DataFrame, model: Model, column: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the probability-like score of label 1 of each whole text."""
    kept = [f for f in df.schema.fields if f.name != name]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for big in pieces(batch, column, 2 << 20):
                for lo in range(0, big.num_rows, _BLOCK):
                    part = big.slice(lo, _BLOCK)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(m.score(part.column(column)))], [*names, name])

    return df.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))
