"""Byte-pair encoding in linear time by backtracking, and decoding by an offset table.

A word's exact merges are found without merging: the longest token that starts at each place
comes from one Aho-Corasick pass over the reversed word; tokens are laid left to right, and a
token may follow another only if merging the two texts would leave that very pair.  That is
a property of the two tokens alone (``compatible``): undo their merges latest first and see
whether an earlier merge would have crossed the border.  Where no token fits, the last one is
taken back and shortened; a place once found hopeless is never entered again, so the work is
linear in the word.

What the tokenizer's file does before (normalizing, splitting at its pattern, bytes to
characters) is left to the library, word by word: no piece and no composed character reaches
over white space.  Words and pieces are remembered, up to ``KEPT`` and ``KEPT_PIECES`` of them.

Decoding copies each id's token from one buffer, by a table of offsets; as the file names no
decoder, tokens are joined by one space, word ends are kept, and ids without a token add
nothing.

Null text: empty, so no ids; null ids: empty text.  Texts of any length are read whole, in
slices that end between words.  Repeated rows and empty tables need nothing special.  Other
columns pass through; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanmask.llm.blocks import pieces, utf8

KEPT, KEPT_PIECES, LONG_WORD = 1 << 18, 1 << 19, 64
SLICE = 4 << 20
#: Symbols are characters from here on, clear of any that means something to a library.
_FIRST = 0x100
_SPACE = re.compile(rb"[ \t-\r]")
#: Punctuation after a word's letters (no apostrophe: the splitter's pattern may name it).
_TAIL = r"([!-&(-/:-@\[-`{-~]*)"
_PROBES = ["Hello", "WORLD!", "a,", "Supercalifragilistic", "x...", "word-(", "it$#", "Then;", "Zz[]{}", "Été", "straße,", "ŒUVRE..."]
_loaded: dict[str, Bpe] = {}


class Merges:
    """Tokens numbered by symbol, then by merge, and the table of what may stand side by side."""

    def __init__(self, symbols: int, merges: list[tuple[int, int]]):
        self.left = [*range(symbols), *(a for a, _ in merges)]
        self.right = [*range(symbols), *(b for _, b in merges)]
        self.joined = {pair: symbols + i for i, pair in enumerate(merges)}
        self.known: dict[int, bool] = {}
        texts, alone = [chr(_FIRST + i) for i in range(symbols)], [True] * symbols
        for i, (a, b) in enumerate(merges, symbols):
            texts.append(texts[a] + texts[b])
            # a token that its own text does not lead to is never made
            alone.append(alone[a] and alone[b] and self._meet(a, b, i))
        self.length = list(map(len, texts))
        self.id_of = {t: i for i, t in enumerate(texts) if alone[i]}
        self.shorter = [self._prefix(t) for t in texts]
        self.automaton = self._automaton()

    def _prefix(self, text: str) -> int:
        return next((self.id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id_of), -1)

    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            found.add_word(text[::-1], i)
        found.make_automaton()
        return found

    def _meet(self, a: int, b: int, before: int) -> bool:
        """Do the merges numbered under ``before`` leave a and b apart?  The later made of the
        two is taken apart until both are symbols; a merge across the border counts if it
        comes before the one just undone (in a tie the place further left goes first)."""
        joined, left, right = self.joined, self.left, self.right
        while True:
            crossing = joined.get((a, b))
            if crossing is not None and crossing < before:
                return False
            inner_a, inner_b = right[a], left[b]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[key] = self._meet(a, b, len(self.left))
        return found

    def encode(self, text: str) -> list[int]:
        """Tokens of a string of symbols."""
        n = len(text)
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        # the automaton names the longest of the tokens that end at a place first; read from the
        # back, places count from the end: longest[-i] starts i symbols before it
        longest, length, shorter, known = [-1] * n, self.length, self.shorter, self.known
        for end, token in self.automaton.iter(text[::-1]):
            if longest[end] < 0:
                longest[end] = token
        out: list[int] = []
        hopeless = bytearray(n + 1)
        left, token, last = n, longest[n - 1], -1
        while True:
            rest = left - length[token]
            if not hopeless[rest]:
                fits = True if last < 0 else known.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if not rest:
                        return out
                    left, last, token = rest, token, longest[rest - 1]
                    continue
            token = shorter[token]
            while token < 0:
                hopeless[left] = 1
                token = out.pop()
                last = out[-1] if out else -1
                left += length[token]
                token = shorter[token]


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # one thread: Spark runs a task per core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec["decoder"]:
            raise ValueError(f"{path}: only plain byte-pair encoding without a decoder of its own")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path}: added tokens must be plain strings without white space")
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        symbols = [t for t in sorted(vocabulary, key=vocabulary.get) if t not in made]
        if len(made) < len(merges) or any(len(s.removesuffix(end) if end else s) != 1 for s in symbols):
            raise ValueError(f"{path}: a token that two merges make, or none")
        number = {s: i for i, s in enumerate([*symbols, *(a + b for a, b in merges)])}
        self.merges = Merges(len(symbols), [(number[a], number[b]) for a, b in merges])
        self.public = np.array([vocabulary[s] for s in number], np.uint32)
        self.ids = [i.to_bytes(4, "little") for i in self.public.tolist()]
        inner = {s: chr(_FIRST + i) for s, i in number.items() if i < len(symbols)}
        self.inside, self.last = _Dropping({ord(s): c for s, c in inner.items() if len(s) == 1}), {s.removesuffix(end): c for s, c in inner.items() if s.endswith(end)}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.pieces: dict[str, bytes] = {}
        self.words = _Words(self)
        # letters that the splitter leaves in one piece with those beside them, and what it shows
        # for them; the way by letters is taken if it gives the same for the probes
        shown = {c: self._shown(f"a{chr(c)}b") for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))}
        self.letters = {c: x[0][1:-1] for c, x in shown.items() if len(x) == 1 and x[0][0] == "a" and x[0][-1] == "b" and len(x[0]) > 2}
        self.plain_word = re.compile("([" + "".join(map(chr, self.letters)) + "]+)" + _TAIL) if self.letters else re.compile("(?!)")
        self.plain = not any(self._may_hide(s) for s in self.added) and all(self._plain(w) in (None, self._any(w)) for w in _PROBES)
        self._table({**vocabulary, **{t["content"]: t["id"] for t in added}})

    def _table(self, vocabulary: dict[str, int]) -> None:
        """All tokens, each with the space that follows it, and the offsets of each id's."""
        size = max(vocabulary.values(), default=-1) + 1
        texts = [b""] * size
        for token, i in vocabulary.items():
            texts[i] = token.encode() + b" "
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(list(map(len, texts)), out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)

    def _may_hide(self, added: str) -> bool:
        """Can a word of letters and punctuation hold this added token?"""
        head = added.lstrip("".join(map(chr, self.letters)))
        return re.fullmatch(_TAIL, head) is not None

    def _shown(self, text: str) -> list[str]:
        """The pieces that the splitter makes of a text."""
        norm = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p for p, _ in self.splitter.pre_tokenize_str(norm) if p] if self.splitter else [norm] * bool(norm)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the splitter."""
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece[:-1].translate(self.inside) + self.last.get(piece[-1], "")
            ids = b"".join(map(self.ids.__getitem__, self.merges.encode(text))) if text else b""
            if len(piece) <= LONG_WORD:
                if len(self.pieces) >= KEPT_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _plain(self, word: str) -> bytes | None:
        """Ids of letters with punctuation after them; None for other words."""
        m = self.plain_word.fullmatch(word)
        if not m:
            return None
        ids = self._piece(m[1].translate(self.letters))
        return ids + self._piece(m[2]) if m[2] else ids

    def _any(self, word: str) -> bytes:
        out = []
        for i, part in enumerate(self.special.split(word) if self.special else [word]):
            out += [self.added[part]] if i % 2 else map(self._piece, self._shown(part))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if len(text) <= SLICE:
            return b"".join(map(self.words.__getitem__, text.split()))
        out, at = [], 0
        while at < len(text):
            gap = _SPACE.search(text, at + SLICE)
            end = gap.start() if gap else len(text)
            out.append(b"".join(map(self.words.__getitem__, text[at:end].split())))
            at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids (unsigned 32-bit)."""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        out = []
        for part in np.split(ids, range(SLICE, len(ids), SLICE)):
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.buffer[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out)[:-1]


class _Dropping(dict):
    """A table for ``str.translate`` that drops characters it does not name."""

    def __missing__(self, c: int) -> None:
        return None


class _Words(dict):
    """Ids by word; encodes a word it does not hold."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        ids = self.bpe._plain(text) if self.bpe.plain else None
        if ids is None:
            ids = self.bpe._any(text)
        if len(word) <= LONG_WORD:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


def bpe(path: str) -> Bpe:
    """The encoder of a file, made once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(name)
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, column: str = "text", output: str = "ids") -> DataFrame:
    """``df`` with the ids of a text column as little-endian unsigned 32-bit integers."""
    df = df if column != output else df.withColumnRenamed(column, column := f"_{column}")
    df, schema = _with(df, output, T.BinaryType())

    def run(batches):
        coder = bpe(path)
        for batch in batches:
            for part in pieces(batch, column):
                data, offsets = utf8(part.column(column))
                raw = data.tobytes()
                ids = [coder.encode(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, column: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of ids as ``encode`` gives them."""
    df, schema = _with(df, output, T.StringType())

    def run(batches):
        coder = bpe(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [coder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return df.mapInArrow(run, schema)
