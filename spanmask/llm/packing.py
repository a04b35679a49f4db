"""Best-fit packing of token pieces by exact-complement hashing.

Only lengths matter for packing, so the plan is made on the histogram of piece lengths (at
most ``capacity`` counters, whatever the corpus): lengths in descending order are completed
exactly from an index of single, pair and triple sums of the lengths still available, each
found combination is consumed as often as the counts allow, and what has no exact
complement is packed best-fit, longest first.  The plan is a list of patterns (lengths that
share a sequence) with multiplicities.  Pieces get their rank within their length, counted
distributedly, and the rank gives pattern, sequence and offset.

Null text: empty, so one piece that holds the end token alone.  Repeated rows are packed each.
Texts of any length are tokenized whole, word by word (the tokenizer drops white space, so
words are independent); only documents over ``capacity`` tokens are cut.  Empty tables give
empty results.  Only the id and the text are read; other columns play no part.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.llm.blocks import pieces, settle, utf8

CACHED_WORDS, CACHED_CORES = 1 << 18, 1 << 19
_RANKED = 500
#: Letters and a tail of ASCII punctuation (no apostrophe): cut there by the tokenizer too.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ["Hello,", "ÉTÉ", "naïve...", "a", "straße!!", "Zürich)", "The***", "xyz|", "Œuvre", "don't", "ab12", "e\u0301", "--", "ÀÖØöøÿ", "Supercalifragilistic$$$", "ﬁn", "<|endoftext|>", "I'm"]
_tokenizers: dict[str, Tokens] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokens:
    """Ids of texts, by word where the tokenizer treats words apart, with caches.

    Words are encoded apart if that gives the ids of the whole text, and a word's letters
    apart from its trailing punctuation, straight by the tokenizer's model, if that gives the
    ids of the word; both are tried on fixed probes, else the longer way is taken."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.words = _Words(self)
        self.cores: dict[str, bytes] = {}
        lower = [c for c in map(chr, range(0xDF, 0x100)) if c != "\u00F7"]
        shown = [self.tok.pre_tokenizer.pre_tokenize_str(c) if self.tok.pre_tokenizer else [] for c in lower]
        self.letters = {ord(c): s[0][0] for c, s in zip(lower, shown, strict=True) if len(s) == 1}
        whole = self._full([" ".join(_PROBES)])[0]
        self.by_word = whole == b"".join(self._full(_PROBES)) == b"".join(self._full(["\n\t".join(_PROBES)]))
        self.by_letters = len(self.letters) == len(lower) and all(self._plain(w) in (None, f) for w, f in zip(_PROBES, self._full(_PROBES), strict=True))
        self.cores.clear()

    def _full(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _core(self, mapped: str) -> bytes:
        ids = self.cores.get(mapped)
        if ids is None:
            if len(self.cores) >= CACHED_CORES:
                self.cores.clear()
            ids = self.cores[mapped] = _packed([t.id for t in self.model.tokenize(mapped)])
        return ids

    def _plain(self, word: str) -> bytes | None:
        """Ids of a word of letters and trailing punctuation; None for other words."""
        m = _PLAIN.fullmatch(word)
        if not m:
            return None
        core = m[1].lower()
        ids = self._core(core if core.isascii() else core.translate(self.letters))
        return ids + self._core(m[2]) if m[2] else ids

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not self.by_word:
            return self._full([text.decode()])[0]
        return b"".join(map(self.words.__getitem__, text.split()))


class _Words(dict):
    """Ids by word; asks the tokenizer for a word it does not hold."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        ids = self.tokens._plain(text) if self.tokens.by_letters else None
        if ids is None:
            ids = self.tokens._full([text])[0]
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


def _tokens(path: str) -> Tokens:
    """The tokenizer of a file, read once per Python worker."""
    if path not in _tokenizers:
        # one thread: Spark runs a task per core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def tokenize_pieces(df: DataFrame, path: str, column: str = "text", id_column: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            for part in pieces(batch, column):
                data, offsets = utf8(part.column(column))
                raw, rows = data.tobytes(), []
                for i in range(part.num_rows):
                    ids = tokens.ids(raw[offsets[i] : offsets[i + 1]]) + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((i, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
                of, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(id_column).take(pa.array(of)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], schema.names)

    return df.select(id_column, column).mapInArrow(run, schema)


def _complement(have: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """Available lengths with sum ``gap``: as few as possible, ``most`` of them at most, the
    longest first."""
    if have[gap]:
        return (gap,)

    def two(total: int, top: int) -> tuple[int, int] | None:
        a = np.arange(min(top, total - 1), (total - 1) // 2, -1)
        a = a[(have[a] > 0) & (have[total - a] > 0)]
        for x in a.tolist():
            if x != total - x or have[x] > 1:
                return x, total - x
        return None

    if most > 1 and (pair := two(gap, gap - 1)):
        return pair
    for a in np.flatnonzero(have[: gap - 1])[::-1].tolist() if most > 2 else ():
        if 3 * a < gap:
            break
        have[a] -= 1
        rest = two(gap - a, a)
        have[a] += 1
        if rest:
            return (a, *rest)
    return None


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used; uses every count up.

    Exact combinations of up to three lengths save most when short lengths abound; where they
    are scarce, using them up so leaves worse residuals.  So the plan is made with
    combinations of up to three, two and one lengths, and the shortest is taken."""
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    left: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while have[length]:
            if length == capacity:
                combo: tuple[int, ...] | None = ()
            else:
                have[length] -= 1
                combo = _complement(have, capacity - length, most)
                have[length] += 1
            if combo is None:
                left.append((length, int(have[length])))
                have[length] = 0
                break
            pattern = (length, *combo)
            times = min(int(have[x]) // pattern.count(x) for x in pattern)
            for x in pattern:
                have[x] -= times
            out.append((pattern, times))
    return out + _best_fit(left, capacity)


def _best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on (length, count); open sequences with equal contents go together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length, n in items:
        while n:
            gap = min((g for g, x in open_.items() if x and g >= length), default=None)
            if gap is None:
                per = min(capacity // length, n)
                times, n = n // per, n % per
                open_[capacity - per * length].append(((length,) * per, times))
                continue
            pattern, times = open_[gap].pop()
            used = min(times, n)
            if times > used:
                open_[gap].append((pattern, times - used))
            open_[gap - length].append(((*pattern, length), used))
            n -= used
    return [x for patterns in open_.values() for x in patterns]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, offset of each run of ranks."""
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            runs[x].append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """``found`` (rows with ``length``; checkpointed or cheap) with sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = _slots(plan(counts, capacity))
    # ranks within a length: lengths with many pieces are split by a hash, so that no task sorts them all
    names = found.columns
    key = F.xxhash64(*names)
    # one row per length: ``capacity`` at most
    parts = found.sparkSession.createDataFrame([(length, -(-n // _RANKED)) for length, n in counts.items()], "length long, _parts long")
    salted = found.join(F.broadcast(parts), "length").withColumn("_salt", F.pmod(key, F.col("_parts"))).select(*names, "_salt")
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*names))
    ranked = salted.withColumn("_rank", within).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                first, sequence, offset = slots[x]
                run = np.searchsorted(first, rank[mine], side="right") - 1
                seq[mine] = sequence[run] + rank[mine] - first[run]
                off[mine] = offset[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str, column: str = "text", id_column: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(settle(tokenize_pieces(df, path, column, id_column, capacity, end_id)), capacity)
