"""Exact removal of repeated passages by fixed-block anchors.

A passage of ``window`` words that occurs twice holds, wherever it occurs, one whole block
of ``b = (window + 1) // 2`` words aligned to multiples of b in its document.  So:

1. Every document's aligned blocks are the index, every rolling run of b words a probe.
   Each chunk of documents sends its distinct probe hashes (twice at most, enough to tell
   one from several) to the hash range that owns them, with a bit for those that are also
   index entries; the owner answers with one bit per index entry: met elsewhere or not.
2. Anchors that were met are extended: each window that holds such an anchor goes, again
   as distinct 64-bit hashes per chunk, to its owner, which answers which repeat.
3. Repeated windows overlap into maximal repeats; the words they cover go.

An owner's share of the hash space is as large as about ``OWNED`` words are to all words, so its
group has one size whatever the corpus and the session's settings, and anchors have so many
bits that about 2**13 hash values stand for each word.

Hot passages cost one entry per chunk, whatever their number of copies, and answers are
bits.  A chunk is a checkpointed block of rows, so answers by position stay valid when
executors are lost.  Repeats are told by 64-bit hashes of the word sequences.

Null text: no words, nothing removed.  Repeated rows are separate documents, so their
windows repeat.  Empty tables give empty results.  Other columns pass through; columns of
the input named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.llm.blocks import Words, chunked, from_bytes, planes, settle, unplanes, utf8

#: Words an owner answers for, and the compressed bytes of text that hold about one.
OWNED, WORD_BYTES = 4 << 20, 2
_SENT = "owner int, chunk long, probes binary, marks binary"
_ANSWER = "chunk long, owner int, hits binary"


def _at_most_two(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    keep = np.ones(len(v), dtype=bool)
    keep[2:] = v[2:] != v[:-2]
    return v[keep]


def _split(sorted_values: np.ndarray, owners: int) -> np.ndarray:
    """Bounds of the owners' ranges of 64-bit hash space in sorted values."""
    cuts = np.array([(i << 64) // owners for i in range(1, owners)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_values, cuts), [len(sorted_values)]])


def _send(chunk: int, values: np.ndarray, index: np.ndarray, owners: int):
    """One row per owner: its distinct values (twice at most) and which are index entries."""
    sent = _at_most_two(values)
    marks = np.isin(sent, index, assume_unique=False) if len(index) else np.zeros(len(sent), bool)
    cut = _split(sent, owners)
    rows = [(o, chunk, planes(sent[a:b]), np.packbits(marks[a:b]).tobytes()) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    if not rows:
        return None
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "chunk", "probes", "marks"])


def _answer(table: pa.Table) -> pa.Table:
    """Which index entries of each chunk occur twice or more among all probes of the range."""
    blobs = table.column("probes").to_pylist()
    values = [unplanes(b) for b in blobs]
    allv = np.sort(np.concatenate(values))
    twice = allv[1:][allv[1:] == allv[:-1]]
    out = []
    for chunk, owner, v, m in zip(table.column("chunk").to_pylist(), table.column("owner").to_pylist(), values, table.column("marks").to_pylist(), strict=True):
        index = np.unique(v[np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)).astype(bool)])
        if not len(twice) or not len(index):
            continue
        at = np.minimum(np.searchsorted(twice, index), len(twice) - 1)
        hit = twice[at] == index
        if hit.any():
            out.append((chunk, owner, np.packbits(hit).tobytes()))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "owner", "hits"])


def _hits(index: np.ndarray, answers: list | None, owners: int) -> np.ndarray:
    """The entries of the sorted distinct index that the answers mark."""
    if not answers or not len(index):
        return index[:0]
    cut, flag = _split(index, owners), np.zeros(len(index), bool)
    for a in answers:
        lo, hi = cut[a["owner"]], cut[a["owner"] + 1]
        flag[lo:hi] = np.unpackbits(np.frombuffer(a["hits"], np.uint8), count=hi - lo).astype(bool)
    return index[flag]


class _Chunk:
    """A chunk's words, its anchors and, after the first answers, its candidate windows."""

    def __init__(self, payload: bytes, column: str, window: int, mask: int = (1 << 64) - (1 << 24)):
        self.batch = from_bytes(payload)
        self.words = Words.of(self.batch.column(column))
        self.hash = self.words.hashes()
        self.window, self.block = window, (window + 1) // 2
        w = self.words
        self.at = w.window_starts(self.block)
        # the highest bits are enough to propose anchors; a false one is dropped in the second step
        self.probe = w.window_hashes(self.hash, self.block, self.at) & np.uint64(mask)
        self.aligned = (self.at - w.first[w.text[self.at]]) % self.block == 0

    def anchors(self) -> np.ndarray:
        return np.unique(self.probe[self.aligned])

    def candidates(self, met: np.ndarray) -> np.ndarray:
        """Starts of the windows whose first whole aligned block is a met anchor."""
        w, b = self.words, self.block
        s = self.at[self.aligned]
        s = s[np.isin(self.probe[self.aligned], met)] if len(met) else s[:0]
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, np.maximum(s - (b - 1), w.first[w.text[s]]), 1)
        np.add.at(change, s + 1, -1)
        starts = w.window_starts(self.window)
        return starts[np.cumsum(change)[starts] > 0]


def _answers(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("chunk").agg(F.collect_list(F.struct("owner", "hits")).alias(name))


def remove_repeats(df: DataFrame, column: str = "text", window: int = 35) -> DataFrame:
    """The rows of ``df`` with ``n_words``, ``n_removed`` (longs) and ``kept_text`` (the words
    outside every repeated window, joined by one space)."""
    df = df.drop("n_words", "n_removed", "kept_text")
    out_schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    chunks = chunked(df, column)
    words = (chunks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // WORD_BYTES
    owners = max(1, -(-words // OWNED))
    mask = (1 << 64) - (1 << (64 - min(64, max(24, words.bit_length() + 13))))

    def anchors(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                c = _Chunk(payload.as_py(), column, window, mask)
                if (sent := _send(chunk, c.probe, c.anchors(), owners)) is not None:
                    yield sent

    def extend(batches):
        for batch in batches:
            for chunk, payload, met in zip(batch.column("chunk").to_pylist(), batch.column("payload"), batch.column("met").to_pylist(), strict=True):
                c = _Chunk(payload.as_py(), column, window, mask)
                v = c.words.window_hashes(c.hash, window, c.candidates(_hits(c.anchors(), met, owners)))
                if len(v) and (sent := _send(chunk, v, v, owners)) is not None:
                    yield sent

    def remove(batches):
        for batch in batches:
            for payload, met, again in zip(batch.column("payload"), batch.column("met").to_pylist(), batch.column("again").to_pylist(), strict=True):
                yield _kept(_Chunk(payload.as_py(), column, window, mask), met, again, owners, column)

    met = settle(_answers(chunks.mapInArrow(anchors, _SENT).groupBy("owner").applyInArrow(_answer, _ANSWER), "met"))
    with_met = chunks.join(met, "chunk", "left")
    again = _answers(with_met.where(F.col("met").isNotNull()).mapInArrow(extend, _SENT).groupBy("owner").applyInArrow(_answer, _ANSWER), "again")
    return with_met.join(again, "chunk", "left").select("payload", "met", "again").mapInArrow(remove, out_schema)


def _kept(c: _Chunk, met, again, owners: int, column: str) -> pa.RecordBatch:
    w = c.words
    starts = c.candidates(_hits(c.anchors(), met, owners))
    v = w.window_hashes(c.hash, c.window, starts)
    starts = starts[np.isin(v, _hits(np.unique(v), again, owners))]
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + c.window, -1)
    gone = np.cumsum(change)[:-1] > 0
    data, offsets = utf8(c.batch.column(column))
    raw, texts, removed = data.tobytes(), [], np.zeros(len(w.count), np.int64)
    for i in range(len(w.count)):
        words, g = raw[offsets[i] : offsets[i + 1]].split(), gone[w.first[i] : w.first[i + 1]]
        removed[i] = g.sum()
        if removed[i]:
            words = [words[j] for j in np.flatnonzero(~g)]
        texts.append(b" ".join(words))
    kept = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*c.batch.columns, pa.array(w.count.astype(np.int64)), pa.array(removed), kept], [*c.batch.schema.names, "n_words", "n_removed", "kept_text"])
