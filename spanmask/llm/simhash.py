"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 majority bits over the XXH64 (seed 42) hashes of word shingles.  Distinct
fingerprints are cut into tiles by population count (and, where a count is frequent, by a
hash into tiles of about ``TILE`` rows).  Two fingerprints within ``radius`` bits have
population counts within ``radius``, so other tile pairs are skipped; each remaining pair
is one task unit, compared exactly with exclusive-or and bit counts.  Inside a pair the
same bound on the counts of three bit ranges skips sub-tiles.  A pair answers with a
spanning forest of its links, never with all pairs of a dense group, and the forests'
components are those of all links.

Null or wordless text: fingerprint 0, linked like any other.  Repeated rows share a
fingerprint and a component.  Null ids never become a component's id unless all its ids
are null.  Empty tables give empty results.  Columns of the input named like an output are
replaced, others but the text pass through; ``one_of_each`` returns the rows as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.llm.blocks import Words, mix64, pieces, settle, utf8
from spanmask.llm.components import components

TILE = 1 << 16
_BLOCK = 1 << 18


def _shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and the bounds of each text's shingles."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    flat = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    fill = np.ones(len(flat), bool)
    fill[end[:-1]] = False
    flat[fill] = words.data[words.inside]
    full = words.window_starts(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    lo = np.concatenate([full, words.first[short]])
    hi = np.concatenate([full + k - 1, words.first[short + 1] - 1])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    view, digest = memoryview(flat), xxhash.xxh64_intdigest
    h = np.fromiter([digest(view[a:b], 42) for a, b in zip(start[lo].tolist(), end[hi].tolist(), strict=True)], np.uint64, len(lo))
    return h, np.searchsorted(lo, words.first)


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits per text: those set in over half of its hashes (none: zero)."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        over = 2 * ones > np.diff(bounds)[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, column: str = "text", k: int = 3, name: str = "fp") -> DataFrame:
    """``df`` without ``column``, with the fingerprint (long) of each whole text."""
    kept = [f for f in df.schema.fields if f.name not in (column, name)]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, column, 1 << 20):
                data, offsets = utf8(part.column(column))
                lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
                fp = majority(*_shingle_hashes(Words(lower, offsets), k))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(fp.view(np.int64))], [*names, name])

    return df.select(*names, column).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def _join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after linking u[i] and v[i]; every entry points to its lowest node."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, root) that connect what links of at most ``radius`` bits connect."""
    same = b is None
    b = a if same else b
    base = 0 if same else len(a)
    nodes = a if same else np.concatenate([a, b])
    root, waiting, held = np.arange(len(nodes)), [], 0

    def compare(i: np.ndarray, j: np.ndarray):
        nonlocal root, held
        step = max(1, _BLOCK // max(1, len(j)))
        right = b[j]
        for s in range(0, len(i), step):
            x, y = np.nonzero(np.bitwise_count(a[i[s : s + step]][:, None] ^ right[None, :]) <= radius)
            if len(x):
                u, v = i[s + x], base + j[y]
                new = root[u] != root[v]
                waiting.append((u[new], v[new]))
                held += int(new.sum())
            if held > _BLOCK:
                settle_waiting()

    def settle_waiting():
        nonlocal root, held
        if waiting:
            root = _join_roots(root, *(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting.clear()
            held = 0

    if len(a) * len(b) <= 1 << 20:
        compare(np.arange(len(a)), np.arange(len(b)))
    else:
        left, right = _subtiles(a), _subtiles(b)
        keys = np.array([k for k, _ in right])
        for n, (key, i) in enumerate(left):
            for m in np.flatnonzero(np.abs(keys - key).sum(axis=1) <= radius):
                if not same or m >= n:
                    compare(i, right[m][1])
    settle_waiting()
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _subtiles(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by the bit counts of three ranges of the fingerprint."""
    parts = [np.bitwise_count(x & np.uint64(m)).astype(np.int64) for m in (0xFFFF, 0xFFFF0000, 0xFFFFFFFF00000000)]
    code = (parts[0] * 64 + parts[1]) * 64 + parts[2]
    order = np.argsort(code, kind="stable")
    cut = np.flatnonzero(np.diff(code[order], prepend=-1))
    return [(np.array([p[i[0]] for p in parts]), i) for i in np.split(order, cut[1:])]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp``: for each pair of tiles a spanning
    forest of all its links within ``radius`` bits."""
    counts = {int(r["ones"]): int(r["n"]) for r in fps.groupBy(F.bit_count("fp").alias("ones")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    salts = {p: -(-n // tile) for p, n in counts.items()}

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            ones = np.bitwise_count(u).astype(np.int64)
            of = np.array([salts.get(p, 1) for p in range(65)], np.uint64)[ones]
            yield pa.RecordBatch.from_arrays([pa.array(ones * (1 << 32) + (mix64(u) % of).astype(np.int64)), pa.array(fp)], ["tile", "fp"])

    def packed(table: pa.Table) -> pa.Table:
        blob = np.sort(table.column("fp").to_numpy()).tobytes()
        return pa.Table.from_arrays([table.column("tile").slice(0, 1), pa.array([blob], pa.binary())], ["me", "blob"])

    def compare(table: pa.Table) -> pa.Table:
        sides = [np.frombuffer(x, np.uint64) for x in table.column("blob").to_pylist()]
        one = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        u, v = _forest(sides[0], None, radius) if one else _forest(*sides, radius) if len(sides) == 2 else (sides[0][:0], sides[0][:0])
        return pa.Table.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    if not counts:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    tiles = fps.select("fp").mapInArrow(deal, "tile long, fp long").groupBy("tile").applyInArrow(packed, "me long, blob binary")
    # each tile meets those within reach; Spark writes its copies one after the other
    parts = F.create_map(*(F.lit(x) for item in sorted(salts.items()) for x in item))
    ones = F.shiftright("me", 32).cast("int")

    def of(q):
        n = F.coalesce(F.try_element_at(parts, q), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: q.cast("long") * (1 << 32) + i)).otherwise(F.array().cast("array<long>"))

    reach = F.flatten(F.transform(F.sequence(ones - radius, ones + radius), of))
    pairs = tiles.select("me", "blob", F.explode(reach).alias("other")).select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), "blob")
    return pairs.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(df: DataFrame, column: str = "text", id_column: str = "doc_id", k: int = 3, radius: int = 3) -> DataFrame:
    """Per row: ``id_column``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest
    id that links reach) and ``component`` (a long, equal within a component)."""
    rows = settle(fingerprints(df.select(F.col(id_column).alias("id"), F.col(column).alias("text")), "text", k))
    classes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    classes = settle(classes)
    roots = components(links(classes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("component"))
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "component").join(lowest, "component")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def one_of_each(df: DataFrame, column: str = "text", id_column: str = "doc_id", k: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df``, one per component: that of the smallest id (nulls last; equal ids:
    the smallest row hash; equal rows: one)."""
    key = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(F.struct("*").alias("row"), F.col(column).alias("text"), F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), key.alias("h")).alias("key"))
    found = near_duplicates(keyed, "text", "key", k, radius)
    best = found.select(F.col("component_id").alias("key")).distinct()
    parts = [F.col(f"key.{x}").alias(f"key_{x}") for x in ("none", "id", "h")]
    mine, best = keyed.select("row", *parts), best.select(F.col("key.none").alias("none"), F.col("key.id").alias("id"), F.col("key.h").alias("h"))
    on = mine.key_none.eqNullSafe(best.none) & mine.key_id.eqNullSafe(best.id) & (mine.key_h == best.h)
    return mine.join(best, on, "left_semi").dropDuplicates(["key_none", "key_id", "key_h"]).select("row.*")
