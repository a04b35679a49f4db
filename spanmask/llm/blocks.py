"""Vectorised words, windows and chunks of text columns inside Arrow tasks.

A word is a maximal run of bytes other than space and U+0009-U+000D.  All functions
take whole texts; nothing is cut or capped.  Hashes are 64-bit polynomial prefix sums
(wrapping), so the hash of any run of words is one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The bytes that separate words: space and U+0009-U+000D.
SPACES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 3 << 19

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _geometric(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n; kept, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())

        def series(b: int) -> np.ndarray:
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        have = _powers[base] = (series(base), series(pow(base, -1, 1 << 64)))
    return have[0][: n + 1], have[1][: n + 1]


def _ranges(codes: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end) for each pair; equal runs have equal hashes anywhere."""
    up, down = _geometric(base, len(codes))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its texts in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a block of texts: byte ranges and, per text, the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = _IS_WORD[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = offsets[(offsets > 0) & (offsets < len(data))]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.count)), self.count)

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*utf8(column))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return _ranges(_BYTE_CODE[self.data], _BYTE_BASE, self.start, self.end)

    def window_starts(self, k: int) -> np.ndarray:
        """Indices of the words at which k words of one text start."""
        i = np.arange(len(self.start))
        return i[i + k <= self.first[1:][self.text]]

    def window_hashes(self, hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
        at = self.window_starts(k) if at is None else at
        return _ranges(hashes, _WORD_BASE, at, at + k)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges bounds[i]:bounds[i+1], empty ones 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def pieces(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts have about ``size`` bytes together (one row at least)."""
    _, offsets = utf8(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 20_000)
        yield batch.slice(lo, hi - lo)
        lo = hi


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


def chunked(df: DataFrame, column: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Rows as compressed blocks (chunk long, payload binary), checkpointed, so that later
    passes meet the same rows in the same order in each block, whatever is recomputed."""

    def pack(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in pieces(batch, column, size):
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([to_bytes(part)], pa.binary())], ["chunk", "payload"])
                n += 1

    return settle(df.mapInArrow(pack, "chunk long, payload binary"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    from spanmask.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def planes(values: np.ndarray) -> bytes:
    """Sorted unsigned values as differences, byte plane by byte plane: the high planes of
    dense values are runs of zeros, which the shuffle's compression takes away."""
    d = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)
