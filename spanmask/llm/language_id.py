"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and mapped to letters and one boundary symbol for any run of other
characters.  Counts of runs of four symbols over all learning rows, per language, are
combined per task and summed by Spark, which derives the continuation counts of the lower
orders.  Each language's model holds every counted run: sorted arrays with the discounted
probability of a run and the interpolation weight of a context, cut into shards of
``ENTRIES`` runs, each a broadcast of its own.  The driver and a task hold one shard at a
time, besides the first ``KEPT`` runs, which tasks keep loaded.  A text gets the language of
the lowest cross-entropy per symbol.

Calibration: models of folds 2 and up judge the learning rows of fold 1.  ``score`` is the
probability that the choice is right, a logistic function of the margin to the second
language; ``rejected`` marks texts whose cross-entropy is beyond what ``REJECT`` of the
calibration texts of that language have, for their length.  The models that predict are then
counted on all learning rows; a language that only fold 1 has is predicted too, without a limit.

Letters of the first plane are their own symbols; those beyond it share the 8,447 code points
of the first plane that no letter has, consecutive letters side by side, so that scripts differ.

Null text or text without a letter: ``und``, score 0, rejected.  Ties go to the language
first in code-point order.  Nothing to learn from: every text is ``und``.  Repeated rows
count each; empty tables give empty results.  Columns of the input named like an output are
replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.llm.blocks import from_bytes, per_text, pieces, settle, to_bytes

ORDER = 4
ENTRIES = 200_000
KEPT = 4_000_000
REJECT = 0.999
FOLDS = 5
_SYMBOL_BITS = 16
_FLUSH = 1 << 21
_letters: list[np.ndarray] = []


def _letter_symbols() -> np.ndarray:
    """Symbol of each code point: itself for letters (from 0xD800 on beyond the first plane),
    else 0."""
    if not _letters:
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        code = np.arange(0x110000)
        _letters.append(np.where(is_letter, np.where(code < 0x10000, code, 0xD800 + code % 8447), 0).astype(np.uint16))
    return _letters[0]


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed runs of ORDER symbols ending at each symbol, the bounds of each text's runs, and
    which texts have a letter."""
    pad = ORDER - 1
    lowered = [(t or "").lower() for t in texts]
    joined = "".join(["\0" * pad + t + "\n" for t in lowered])
    size = np.array([len(t) + pad + 1 for t in lowered], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    symbols = _letter_symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    padding = np.zeros(len(symbols) + 1, bool)
    for i in range(pad):
        padding[first[:-1] + i] = True
    padding = padding[:-1]
    keep = symbols != 0
    keep[1:] |= keep[:-1].copy()
    keep |= padding
    letters = per_text((symbols != 0).astype(np.int64), first) > 0
    bounds = per_text((keep & ~padding).astype(np.int64), first)
    s, real = symbols[keep].astype(np.uint64), ~padding[keep]
    code = s.copy()
    for i in range(1, ORDER):
        code[i:] |= s[:-i] << np.uint64(_SYMBOL_BITS * i)
    return code[real], np.concatenate([[0], np.cumsum(bounds)]), letters


def _count(batches):
    """(lang, run, n) summed within the task as far as memory allows."""
    held: dict[str, list] = {}

    def summed(parts):
        code = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        u, at = np.unique(code, return_inverse=True)
        return u, np.bincount(at, n, len(u)).astype(np.int64)

    def out(lang):
        u, n = summed(held.pop(lang))
        for lo in range(0, len(u), 100_000):
            m = len(u[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(u[lo : lo + m].view(np.int64)), pa.array(n[lo : lo + m])], ["lang", "run", "n"])

    for batch in batches:
        for part in pieces(batch, "text"):
            code, bounds, letters = runs(part.column("text").to_pylist())
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = [code[bounds[i] : bounds[i + 1]] for i in np.flatnonzero((langs == lang) & letters)]
                if mine:
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(np.concatenate(mine), return_counts=True))
                    if sum(len(p[0]) for p in parts) > _FLUSH:
                        held[lang] = [summed(parts)]
                        if len(held[lang][0][0]) > _FLUSH // 2:
                            yield from out(lang)
    for lang in sorted(held):
        yield from out(lang)


def _mask(order: int) -> int:
    value = (1 << (_SYMBOL_BITS * order)) - 1
    return value if value < 1 << 63 else -1


def _orders(counts: DataFrame) -> DataFrame:
    """(lang, order, run, n, total, kinds): counts (below the highest order, of distinct left
    neighbours), with the sum and the number of the runs that share the context."""
    now, out = counts, None
    for order in range(ORDER, 0, -1):
        ctx = F.shiftrightunsigned("run", _SYMBOL_BITS)
        sums = now.groupBy("lang", ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        one = now.withColumn("ctx", ctx).join(sums, ["lang", "ctx"]).select("lang", F.lit(order).alias("order"), "run", "n", "total", "kinds")
        out = one if out is None else out.unionByName(one)
        now = now.groupBy("lang", F.col("run").bitwiseAND(F.lit(_mask(order - 1))).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return out


def _parts(table: DataFrame):
    """(lang, order, run, n, total, kinds) of all rows in the order of lang, order and run, some
    thousand at a time; the driver holds those of one partition."""

    def pack(batches):
        for batch in batches:
            for (lang, order), t in batch.to_pandas().groupby(["lang", "order"]):
                part = pa.RecordBatch.from_pandas(t[["run", "n", "total", "kinds"]], preserve_index=False)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([order], pa.int32()), pa.array([to_bytes(part)], pa.binary())], ["lang", "order", "part"])

    ordered = table.select("lang", "order", "run", "n", "total", "kinds").orderBy("lang", "order", "run")
    for r in ordered.mapInArrow(pack, "lang string, order int, part binary").toLocalIterator():
        part = from_bytes(bytes(r["part"]))
        yield (r["lang"], r["order"], *(c.to_numpy() for c in part.columns))


class _Shard:
    """Probabilities of neighbouring runs, weights of their contexts."""

    def __init__(self, run: np.ndarray, probability: np.ndarray, ctx: np.ndarray, weight: np.ndarray):
        ctx, at = np.unique(ctx, return_index=True)
        self.run, self.probability, self.ctx, self.weight = run, probability.astype(np.float32), ctx, weight[at].astype(np.float32)


class _Place:
    """Bounds of a shard, and the shard or its broadcast."""

    def __init__(self, shard: _Shard, kept: bool, store):
        self.run, self.ctx = (shard.run[0], shard.run[-1]), (shard.ctx[0], shard.ctx[-1])
        self.kept, self.held = kept, store(shard)

    def fill(self, run: np.ndarray, probability: np.ndarray, ctx: np.ndarray, weight: np.ndarray) -> None:
        """Puts what the shard knows of the sorted ``run`` and ``ctx`` into the other two."""
        a, b = np.searchsorted(run, self.run[0]), np.searchsorted(run, self.run[1], "right")
        c, d = np.searchsorted(ctx, self.ctx[0]), np.searchsorted(ctx, self.ctx[1], "right")
        if a == b and c == d:
            return
        shard = self.held.value if isinstance(self.held, Broadcast) else self.held
        for mine, out, key, value in ((run[a:b], probability[a:b], shard.run, shard.probability), (ctx[c:d], weight[c:d], shard.ctx, shard.weight)):
            at = np.searchsorted(key, mine)
            met = key[at] == mine
            out[met] = value[at[met]]
        if isinstance(self.held, Broadcast) and not self.kept:
            self.held.__dict__.pop("_value", None)  # read again from the executor's disk when needed


class Model:
    """Per language and order: discounted probabilities of runs, weights of contexts, in shards.

    ``table``: rows (lang, order, run, n, total, kinds), as a frame or in parts ordered by these."""

    def __init__(self, table, kinds_of_counts: pd.DataFrame, entries: int = ENTRIES, store=lambda shard: shard):
        if isinstance(table, pd.DataFrame):
            by = table.sort_values(["lang", "order", "run"]).groupby(["lang", "order"])
            table = ((lang, order, *(t[x].to_numpy() for x in ("run", "n", "total", "kinds"))) for (lang, order), t in by)
        discounts = {}
        for c in kinds_of_counts.itertuples():
            n1, n2 = float(c.n1), float(c.n2)
            discounts[c.lang, c.order] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        found: dict[str, list] = {}
        letters: dict[str, int] = {}
        size, waiting, at = 0, [], None

        def shard():
            nonlocal size
            lang, order = at
            run, n, total, kinds = (np.concatenate(x) for x in zip(*waiting, strict=True))
            d = discounts.get(at, 0.5)
            ctx = (run.view(np.uint64) >> np.uint64(_SYMBOL_BITS)).view(np.int64) if order > 1 else np.zeros(len(run), np.int64)
            size += len(run)
            levels = found.setdefault(lang, [[] for _ in range(ORDER)])
            levels[order - 1].append(_Place(_Shard(run, (n - d) / total, ctx, d * kinds / total), size <= KEPT, store))
            waiting.clear()

        for lang, order, *part in table:
            if waiting and (at != (lang, order) or sum(len(w[0]) for w in waiting) >= entries):
                shard()
            at = (lang, order)
            if order == 1:
                letters[lang] = letters.get(lang, 0) + len(part[0])
            for lo in range(0, len(part[0]), entries):
                if lo:
                    shard()
                waiting.append([x[lo : lo + entries] for x in part])
        if waiting:
            shard()
        self.langs = sorted(found)
        self.orders = [found[lang] for lang in self.langs]
        self.floor = [1.0 / (1 + letters[lang]) for lang in self.langs]
        self.slope, self.typical, self.limit = 1.0, np.zeros(len(self.langs)), np.full(len(self.langs), np.inf)

    def calibrated_like(self, other: Model) -> Model:
        """This model with the other's calibration of the languages they share."""
        at = {lang: i for i, lang in enumerate(other.langs)}
        self.slope = other.slope
        for i, lang in enumerate(self.langs):
            if lang in at:
                self.typical[i], self.limit[i] = other.typical[at[lang]], other.limit[at[lang]]
        return self

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithms per run and language."""
        out = np.empty((len(code), len(self.langs)), np.float32)
        masks = [np.uint64((1 << (_SYMBOL_BITS * n)) - 1) for n in range(ORDER + 1)]
        run = [np.unique((code & masks[n]).view(np.int64), return_inverse=True) for n in range(1, ORDER + 1)]
        ctx = [np.unique(((code >> np.uint64(_SYMBOL_BITS)) & masks[n]).view(np.int64), return_inverse=True) for n in range(ORDER)]
        for k, levels in enumerate(self.orders):
            p = np.full(len(code), self.floor[k], np.float32)
            for (runs_, run_at), (ctxs, ctx_at), places in zip(run, ctx, levels, strict=True):
                probability, weight = np.zeros(len(runs_), np.float32), np.ones(len(ctxs), np.float32)
                for place in places:
                    place.fill(runs_, probability, ctxs, weight)
                p = probability[run_at] + weight[ctx_at] * p
            out[:, k] = np.log(np.maximum(p, 1e-12))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language; symbols and presence of a letter by text."""
        code, bounds, letters = runs(texts)
        which, kinds = pd.factorize(code)
        logp = self.log_probabilities(kinds)
        size = np.diff(bounds)
        total = np.stack([per_text(logp[:, k][which], bounds) for k in range(len(self.langs))], axis=1)
        return -total / np.maximum(1, size)[:, None], size, letters

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), its cross-entropy, the margin in units of 1/sqrt(symbols),
        symbols."""
        n = len(texts)
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        h, size, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(n), best]
        second = np.sort(h, axis=1)[:, 1] if len(self.langs) > 1 else low + 1.0
        return np.where(letters, best, -1), low, (second - low) * np.sqrt(size), size, letters


def fit(docs: DataFrame, column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", entries: int = ENTRIES) -> Model:
    """Learns from rows with a language whose fold (crc32 of the id, modulo FOLDS) is not 0."""
    fold = F.crc32(F.col(id_column).cast("string")) % FOLDS
    known = docs.select(F.col(column).alias("text"), F.col(lang_column).alias("lang"), fold.alias("fold")).where("lang is not null and text is not null and fold <> 0")

    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.select("lang", "text").mapInArrow(_count, "lang string, run long, n long")
        return settle(counts.groupBy("lang", "run").agg(F.sum("n").alias("n")))

    first, others = counted(known.where("fold = 1")), counted(known.where("fold > 1"))
    tried = _calibrated(known.where("fold = 1").select("lang", "text"), _model(others, entries))
    whole = settle(first.unionByName(others).groupBy("lang", "run").agg(F.sum("n").alias("n")))
    return _model(whole, entries).calibrated_like(tried)


def _model(counts: DataFrame, entries: int) -> Model:
    table = settle(_orders(counts))
    kinds = table.where("n <= 2").groupBy("lang", "order").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    return Model(_parts(table), kinds.toArrow().to_pandas(), entries, counts.sparkSession.sparkContext.broadcast)


def _calibrated(rows: DataFrame, model: Model) -> Model:
    if not model.langs:
        return model
    m = model  # tasks get the shards' places with the function, the shards as broadcasts

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                best, low, margin, size, letters = m.judge(part.column("text").to_pylist())
                right = np.array([b >= 0 and m.langs[b] == t for b, t in zip(best, part.column("lang").to_pylist(), strict=True)], bool)
                cols = [best.astype(np.int32), low, np.sqrt(size), margin, right]
                yield pa.RecordBatch.from_arrays([pa.array(c[letters]) for c in cols], ["best", "low", "root", "margin", "right"])

    seen = settle(rows.mapInArrow(run, "best int, low double, root double, margin double, right boolean"))
    slopes = (0.1, 0.3, 1.0, 3.0, 10.0)
    loss = [F.sum(F.log1p(F.exp(-F.least(s * F.col("margin"), F.lit(30.0)) * F.when(F.col("right"), 1.0).otherwise(-1.0)))).alias(f"l{i}") for i, s in enumerate(slopes)]
    total = seen.agg(*loss).first()
    if total["l0"] is not None:
        model.slope = min(zip((total[f"l{i}"] for i in range(len(slopes))), slopes, strict=True))[1]
    right = seen.where("right")
    typical = right.groupBy("best").agg(F.avg("low").alias("typical"))
    far = right.join(F.broadcast(typical), "best").groupBy("best").agg(F.max("typical").alias("typical"), F.percentile_approx((F.col("low") - F.col("typical")) * F.col("root"), REJECT, 10_000).alias("far"))
    for r in far.collect():  # one row per language
        model.typical[r["best"]], model.limit[r["best"]] = r["typical"], r["far"]
    return model


def predict(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``df`` without ``column``, with ``lang_pred``, ``score``, ``entropy``, ``rejected``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in df.schema.fields if f.name != column and f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    m = model

    def run(batches):
        for batch in batches:
            for part in pieces(batch, column):
                best, low, margin, size, _ = m.judge(part.column(column).to_pylist())
                none = best < 0
                score = np.where(none, 0.0, 1 / (1 + np.exp(-np.minimum(m.slope * margin, 30.0))))
                far = np.zeros(len(best), bool)
                if m.langs:
                    far = (low - m.typical[best]) * np.sqrt(size) > m.limit[best]
                lang = [m.langs[b] if b >= 0 else "und" for b in best]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(np.where(none, 0.0, low)), pa.array(none | far)], [*names, *(a.name for a in added)])

    return df.select(*names, column).mapInArrow(run, T.StructType([*kept, *added]))
