"""Quality rules: exact text statistics and a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams (relative
frequencies within each family), fitted on at most ``TRAIN_ROWS`` labelled rows of each
label, with probabilities calibrated (Platt) on a quarter of them that the fit does not see.
Scores of whole texts are means of weights over positions, computed per Arrow batch.

Null text: no words, so the base rule fails it.  A text is kept if the base rule passes and
the calibrated probability of quality 1 reaches ``THRESHOLD``.  Repeated rows are judged
each.  No labels at all, or one label only: the classifier's probability is that label's
smoothed frequency.  Empty tables give empty results.  Columns of
the input named like an output are replaced, others but the text pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.llm.blocks import SPACES, Words, mix64, per_text, pieces, utf8
from spanmask.llm.features import labelled_sample, ngrams

TRAIN_ROWS = 2048
BITS = 16
THRESHOLD = 0.5
#: The symbols that the base statistics count.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int8)
_IS_SYMBOL[list(SYMBOLS)] = 1
_SCALE = 20.0


def statistics(column, repeat_window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = utf8(column)
    w = Words(data, offsets)
    chars = w.inside & ((data & 0xC0) != 0x80)
    out = {"n_words": w.count.astype(np.int64), "word_chars": per_text(chars, offsets), "n_symbols": per_text(_IS_SYMBOL[data], offsets)}
    # windows of a text that occur in it twice, told by a hash of the words and the text's number
    at = w.window_starts(repeat_window)
    key = w.window_hashes(w.hashes(), repeat_window, at) ^ mix64(w.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(w) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + repeat_window, -1)
    out["n_repeat_words"] = per_text((np.cumsum(change)[:-1] > 0).astype(np.int64), w.first)
    raw, dup = data.tobytes(), np.zeros(len(w.count), np.int64)
    for i in range(len(w.count)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(SPACES)]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    return out


def _means(column, weights: np.ndarray) -> np.ndarray:
    n, families = ngrams(column, BITS)
    z = np.full(n, float(weights[-1]))
    size = 1 << BITS
    for f, (h, bounds) in enumerate(families):
        total = per_text(weights[f * size : (f + 1) * size][h].astype(np.float64), bounds)
        z += _SCALE * total / np.maximum(1, np.diff(bounds))
    return z


def _sparse(batches):
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            n, families = ngrams(part.column("text"), BITS)
            index, value, size = [], [], 1 << BITS
            for i in range(n):
                cols, vals = [], []
                for f, (h, b) in enumerate(families):
                    u, c = np.unique(h[b[i] : b[i + 1]], return_counts=True)
                    cols.append(u.astype(np.int32) + f * size)
                    vals.append((_SCALE * c / max(1, c.sum())).astype(np.float32))
                index.append(np.concatenate(cols).tobytes())
                value.append(np.concatenate(vals).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.binary()), pa.array(value, pa.binary()), part.column("label"), part.column("weight")], ["idx", "val", "label", "weight"])


class _Rows:
    def __init__(self, rows):
        self.idx = np.concatenate([np.frombuffer(r["idx"], np.int32) for r in rows])
        self.val = np.concatenate([np.frombuffer(r["val"], np.float32) for r in rows])
        size = np.array([len(r["idx"]) // 4 for r in rows])
        self.row, self.bounds = np.repeat(np.arange(len(rows), dtype=np.int32), size), np.concatenate([[0], np.cumsum(size)])
        self.y = np.array([r["label"] for r in rows], np.float64)
        self.w = np.array([r["weight"] for r in rows], np.float64)
        self.w /= self.w.sum()

    def linear(self, w: np.ndarray) -> np.ndarray:
        if not len(self.idx):
            return np.full(len(self.y), float(w[-1]))
        sums = np.add.reduceat(w[self.idx] * self.val, np.minimum(self.bounds[:-1], len(self.idx) - 1), dtype=np.float64)
        return np.where(np.diff(self.bounds) > 0, sums, 0.0) + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, steps: int = 120) -> tuple[np.ndarray, float, float]:
    """Weights (the last is the bias) and the slope and shift of the calibration."""
    sample = labelled_sample(docs, labels, label, rows)
    got = sample.mapInArrow(_sparse, "idx binary, val binary, label int, weight double").toArrow().to_pylist()  # 2 * rows texts at most
    got.sort(key=lambda r: (r["label"], r["idx"], r["val"]))
    dims = 4 * (1 << BITS) + 1
    w = np.zeros(dims, np.float32)
    seen = {r["label"] for r in got}
    if len(seen) < 2:
        p = (sum(r["label"] for r in got) + 0.5) / (len(got) + 1.0)
        return w, 0.0, float(np.log(p / (1 - p)))
    learn, check = [r for i, r in enumerate(got) if i % 4], got[::4]
    if len({r["label"] for r in check}) < 2 or len({r["label"] for r in learn}) < 2:
        learn = check = got
    a, b, m, v = _Rows(learn), _Rows(check), np.zeros(dims), np.zeros(dims)
    del got, learn, check
    for t in range(1, steps + 1):
        g = (_sigmoid(a.linear(w)) - a.y) * a.w
        grad = np.bincount(a.idx, a.val * g.astype(np.float32)[a.row], dims) + 1e-5 * w
        grad[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = (w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)).astype(np.float32)
    z = b.linear(w)
    n1, n0 = b.y.sum(), len(b.y) - b.y.sum()
    goal = np.where(b.y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's two parameters
        p = _sigmoid(slope * z + shift)
        r, h = (p - goal) * b.w, p * (1 - p) * b.w + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(r * z).sum(), r.sum()]))
        step *= min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
        slope, shift = slope - step[0], shift - step[1]
    return w, float(slope), float(shift)


def judge(df: DataFrame, model: tuple[np.ndarray, float, float], column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without ``column``, with the statistics, base_failed, quality (probability), kept."""
    names_out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*(T.StructField(n, T.LongType()) for n in names_out), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    kept_cols = [f for f in df.schema.fields if f.name != column and f.name not in {a.name for a in added}]
    names = [f.name for f in kept_cols]
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS weights

    def run(batches):
        w, slope, shift = shared.value
        for batch in batches:
            for part in pieces(batch, column, 2 << 20):
                text = part.column(column)
                s = statistics(text)
                p = _sigmoid(slope * _means(text, w) + shift)
                failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(s[n].astype(np.int64)) for n in names_out), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [*names, *names_out, "base_failed", "quality", "kept"])

    return df.select(*names, column).mapInArrow(run, T.StructType([*kept_cols, *added]))
