"""Phrase collocations from a weighted de Bruijn graph of the corpus's word runs.

Every place of a text starts one longest gram: its next ``longest`` words, fewer where its
piece ends.  Grams of full length are the edges of a graph whose nodes are the grams one word
shorter; an edge's weight is its number of occurrences.  Counts of shorter phrases are never
taken from the text: a phrase occurs as often as weight flows out of the node it is, plus the
correction for the places where its piece ends with it, so all follow from the weights of the
longest grams that begin with it.

1. Only phrases that occur ``least`` times matter.  Each chunk of texts sends its distinct
   grams, as short hashes with counts up to ``least``, to the hash range that owns them; the
   owner answers with one bit each: may be frequent or not.  Hashes can only meet, never part,
   so the bits never lose a phrase.  A gram that can't be frequent is cut to its longest
   beginning that may be; the cut place then counts to the flow of that beginning.
2. Each chunk builds its graph of what is left, words told apart by their bytes, and compacts
   unary paths: edges of equal weight joined by nodes with one edge in and one out become one
   row, a run of words with a weight.  A passage that thousands of texts share is one row a chunk.
3. Equal paths of all chunks meet at the owner of their first gram's hash, in sorted, compressed
   blocks, and are summed; then they are opened to edges, and edges are summed.  Flow and
   corrections give the counts of all shorter phrases.

Chunks are checkpointed blocks of about ``CHUNK`` bytes, cut between pieces, so a long text is
read by many tasks; owners hold about ``OWNED`` hashes.  A phrase that makes up a third of
the corpus is one entry a chunk.

Null text: empty; null language: ``und``.  Repeated rows count each.  A language without
candidates has no rows.  Empty tables give empty results.  Columns other than the two named
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.llm.blocks import Words, from_bytes, mix64, planes, settle, to_bytes, unplanes, utf8

CHUNK, OWNED = 2 << 20, 4 << 20
LONGEST, LEAST, SCALE = 4, 30, 2_000_000

#: Piece ends become line feeds, other spaces stay, A-Z are lower-cased.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10
_ENDS = b".,;:!?\n\x0b\x0c\r"
_SENT = "owner int, chunk long, grams binary, counts binary"
_ANSWER = "chunk long, owner int, bits binary"
_BLOCKS = "owner int, lang string, grams binary, sizes binary, weights binary"
_GRAMS = "lang string, gram string, size int, weight long"


def _slices(text: bytes, size: int):
    """A text in slices of about ``size`` bytes that end with a piece."""
    at = 0
    while len(text) - at > size:
        ends = [e for e in (text.rfind(bytes([c]), at, at + size) for c in _ENDS) if e >= 0]
        if not ends:
            later = [e for e in (text.find(bytes([c]), at + size) for c in _ENDS) if e >= 0]
            if not later:
                break
            ends = [min(later)]
        yield text[at : max(ends) + 1]
        at = max(ends) + 1
    yield text[at:]


def _block(chunk: int, held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    langs, texts = zip(*held, strict=True)
    payload = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["lang", "text"])
    words = len(Words.of(payload.column("text")))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([words], pa.int64()), pa.array([to_bytes(payload)], pa.binary())], ["chunk", "words", "payload"])


def _chunks(size: int):
    def chunks(batches):
        """Blocks of texts: chunk, number of words, payload."""
        from pyspark import TaskContext

        chunk, held, have = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for part in _slices(text.as_py(), size):
                    held.append((lang, part))
                    have += len(part) + 32
                    if have >= size:
                        yield _block(chunk, held)
                        chunk, held, have = chunk + 1, [], 0
        if held:
            yield _block(chunk, held)

    return chunks


class _Chunk:
    """Words of a chunk's texts: folded bytes, hashes, and how many words each piece still has."""

    def __init__(self, payload: bytes):
        self.batch = from_bytes(payload)
        data, offsets = utf8(self.batch.column("text"))
        self.words = w = Words(_FOLD[data], offsets)
        n = len(w)
        ends = np.cumsum(w.data == 10, dtype=np.int32)
        new = np.ones(n + 1, bool)
        if n:
            piece = ends[w.start]
            new[1:n] = (piece[1:] != piece[:-1]) | (w.text[1:] != w.text[:-1])
        stop = np.flatnonzero(new)
        self.left = (stop[np.searchsorted(stop, np.arange(n), "right")] - np.arange(n)) if n else np.zeros(0, np.int64)
        names = self.batch.column("lang").dictionary_encode()
        self.langs, self.lang = names.dictionary.to_pylist(), names.indices.to_numpy()[w.text]

    def starts(self, size: int) -> np.ndarray:
        """The words at which ``size`` words of one piece start."""
        return np.flatnonzero(self.left >= size)

    def hashes(self, longest: int, bits: int) -> list[np.ndarray]:
        """Per size, the grams at ``starts(size)`` as numbers of ``bits`` bits."""
        w = self.words
        salts = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        one, salt, out = w.hashes(), mix64(salts + np.uint64(1))[self.lang], []
        for size in range(1, longest + 1):
            at = self.starts(size)
            h = one if size == 1 else w.window_hashes(one, size, at)
            out.append(mix64(h ^ salt[at] ^ np.uint64(size)) >> np.uint64(64 - bits))
        return out


def _cuts(bits: int, owners: int) -> np.ndarray:
    return np.array([(i << bits) // owners for i in range(1, owners)], np.uint64)


def _owned(values: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Bounds of the owners' ranges in sorted values."""
    return np.concatenate([[0], np.searchsorted(values, _cuts(bits, owners)), [len(values)]])


def _send(chunk: int, values: np.ndarray, bits: int, owners: int, least: int) -> pa.RecordBatch:
    """One row per owner: its distinct values and their counts, ``least`` at most."""
    distinct, counts = np.unique(values, return_counts=True)
    counts = np.minimum(counts, least).astype("<u4" if least > 255 else np.uint8)
    cut = _owned(distinct, bits, owners)
    rows = [(o, chunk, planes(distinct[a:b]), counts[a:b].tobytes()) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["owner", "chunk", "grams", "counts"])


def _answer(least: int):
    def answer(table: pa.Table) -> pa.Table:
        """Which of each chunk's values have ``least`` occurrences or more in all chunks."""
        values = [unplanes(b.as_py()) for b in table.column("grams")]
        counts = np.concatenate([np.frombuffer(b.as_py(), "<u4" if least > 255 else np.uint8) for b in table.column("counts")])
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        often = every[first[np.add.reduceat(counts[order].astype(np.int64), first) >= least]]
        out = []
        for chunk, owner, v in zip(table.column("chunk").to_pylist(), table.column("owner").to_pylist(), values, strict=True):
            if len(often):
                hit = often[np.minimum(np.searchsorted(often, v), len(often) - 1)] == v
                if hit.any():
                    out.append((chunk, owner, np.packbits(hit).tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "owner", "bits"])

    return answer


def _frequent(distinct: np.ndarray, answers: list | None, bits: int, owners: int) -> np.ndarray:
    """Per distinct value, what its owner answered."""
    flag, cut = np.zeros(len(distinct), bool), _owned(distinct, bits, owners)
    for a in answers or ():
        lo, hi = cut[a["owner"]], cut[a["owner"] + 1]
        flag[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
    return flag


def _depths(c: _Chunk, answers: list | None, longest: int, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word, the size of the longest gram from there all of whose beginnings may be
    frequent (0: none), and that gram's hash."""
    grams = c.hashes(longest, bits)
    distinct, number = np.unique(np.concatenate(grams), return_inverse=True)
    often = _frequent(distinct, answers, bits, owners)[number]
    depth, value, lo = np.zeros(len(c.words), np.int8), np.zeros(len(c.words), np.uint64), 0
    for size, g in enumerate(grams, 1):
        at = c.starts(size)
        deeper = often[lo : lo + len(g)] & (depth[at] == size - 1)
        depth[at[deeper]], value[at[deeper]] = size, g[deeper]
        lo += len(g)
    return depth, value


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end) for each pair, as strings."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    raw = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]).cast(pa.binary()).cast(pa.string())


def _ids(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (before, word), equal for equal pairs."""
    return np.unique(before * np.int64(word.max(initial=0) + 1) + word, return_inverse=True)[1]


def _graph(c: _Chunk, depth: np.ndarray, longest: int) -> tuple[np.ndarray, pa.Table]:
    """The chunk's unary paths and cut grams with their weights, and per language, as a gram of
    size 0, the places that start none; before it, the words at which the first ones start."""
    w, n = c.words, len(c.words)
    # words in a row, one space between them
    size = w.end - w.start
    ends = np.cumsum(size + 1)
    begins = ends - size - 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    letters = w.data[w.inside]
    held = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
    held[np.repeat(np.arange(n), size) + np.arange(len(letters))] = letters
    bare = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    word = bare.dictionary_encode().indices.to_numpy().astype(np.int64)
    # node[i]: the gram of longest - 1 words from i; edge[i]: that of longest words
    gram, kinds = np.full(n, -1, np.int64), []
    number = _ids(c.lang.astype(np.int64), word)
    for k in range(1, longest + 1):
        kinds.append(number)
        mine = depth == k
        gram[mine] = number[mine] * longest + (k - 1)
        if k < longest:
            follow = np.minimum(np.arange(n) + k, max(n - 1, 0))
            # places whose piece is over keep numbers that no one reads
            number = _ids(number, word[follow])
    distinct, first, back, weight = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
    full = depth == longest
    i = np.flatnonzero(full[:-1] & full[1:] & (c.left[:-1] > longest))
    # the nodes after and before edges: in-edges and out-grams that differ
    at_end = np.flatnonzero(full)
    node = kinds[longest - 2]
    into, outof = at_end + 1, np.flatnonzero(depth >= longest - 1)
    n_in = _distinct(node[into], back[at_end], n)
    n_out = _distinct(node[outof], back[outof], n)
    v = node[i + 1]
    linked = i[(n_in[v] == 1) & (n_out[v] == 1) & (weight[back[i]] == weight[back[i + 1]]) & (back[i] != back[i + 1])]
    link = np.zeros(n + 1, bool)
    link[linked] = True
    follows = np.zeros(len(distinct), bool)
    follows[back[linked + 1]] = True
    # paths start at edges that follow none; their run of links is read at the first occurrence
    # (each piece ends a path, so no path is a ring without a start)
    stop = np.flatnonzero(~link)
    starts = (distinct >= 0) & ~follows
    rep, sums, of = first[starts], weight[starts], distinct[starts] % longest + 1
    length = of + np.where(of == longest, stop[np.searchsorted(stop, rep)] - rep, 0)
    none = np.bincount(c.lang[depth == 0], minlength=len(c.langs))
    langs, at = pa.array(c.langs, pa.string()), np.flatnonzero(none)
    lang = pa.concat_arrays([langs.take(pa.array(c.lang[rep].astype(np.int64))), langs.take(pa.array(at))])
    grams = pa.concat_arrays([_strings(held, begins[rep], ends[rep + length - 1] - 1), pa.array([""] * len(at), pa.string())])
    sizes = pa.array(np.concatenate([length, np.zeros(len(at), np.int64)]).astype(np.int32))
    weights = pa.array(np.concatenate([sums, none[at]]).astype(np.int64))
    return rep, pa.table([lang, grams, sizes, weights], ["lang", "gram", "size", "weight"])


def _blocks(table: pa.Table, owner: np.ndarray) -> pa.RecordBatch:
    """The table's rows by owner and language, sorted, so that they compress well."""
    table = table.append_column("owner", pa.array(owner, pa.int32())).sort_by([("owner", "ascending"), ("lang", "ascending"), ("gram", "ascending")])
    owner, lang = table.column("owner").to_numpy(), table.column("lang").combine_chunks().dictionary_encode()
    name = (lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang).indices.to_numpy()
    cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (name[1:] != name[:-1])) + 1).tolist(), len(owner)]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        part = table.slice(a, b - a)
        # no word holds a line feed
        texts = "\n".join(part.column("gram").to_pylist()).encode()
        numbers = (part.column("size").to_numpy().astype("<i4"), part.column("weight").to_numpy().astype("<i8"))
        rows.append((int(owner[a]), part.column("lang")[0].as_py(), zlib.compress(texts, 1), *(zlib.compress(_bytewise(x), 1) for x in numbers)))
    columns = zip(*rows, strict=True) if rows else [()] * 5
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["owner", "lang", "grams", "sizes", "weights"])


def _bytewise(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _summed(table: pa.Table) -> pa.Table:
    """The rows of an owner's blocks, equal ones as one with the sum of their weights."""
    parts = []
    for lang, grams, sizes, weights in zip(*(table.column(c).to_pylist() for c in ("lang", "grams", "sizes", "weights")), strict=True):
        texts = pa.array(zlib.decompress(grams).decode().split("\n"), pa.string())
        parts.append(pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(texts)), texts, pa.array(_numbers(sizes, "<i4")), pa.array(_numbers(weights, "<i8"))], ["lang", "gram", "size", "weight"]))
    out = pa.concat_tables(parts).group_by(["lang", "gram", "size"]).aggregate([("weight", "sum")])
    return out.rename_columns({"weight_sum": "weight"}).select(["lang", "gram", "size", "weight"])


def _distinct(group: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """Per group number, its different members."""
    width = np.int64(member.max(initial=0) + 1)
    return np.bincount(np.unique(group * width + member) // width, minlength=n)


def weighted_paths(df: DataFrame, column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(lang, gram, size, weight): compacted paths (``longest`` words or more) and cut grams of
    all chunks; size 0 holds the places whose first word is not frequent."""
    rows = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    chunks = settle(rows.mapInArrow(_chunks(chunk), "chunk long, words long, payload binary"))
    words = chunks.agg(F.sum("words")).first()[0] or 0
    owners = max(1, -(-longest * words // OWNED))
    # some sixteen occurrences a value: grams seen a few times seldom reach ``least`` by chance or
    # meet a frequent one; those that do are told apart by their words later
    bits = min(64, max(16, (longest * words).bit_length() - 4))
    summing = max(1, owners // 4)

    def send(batches):
        for batch in batches:
            for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                yield _send(number, np.concatenate(_Chunk(payload.as_py()).hashes(longest, bits)), bits, owners, least)

    def paths(batches):
        for batch in batches:
            for number, payload, answers in zip(batch.column("chunk").to_pylist(), batch.column("payload"), batch.column("answers").to_pylist(), strict=True):
                c = _Chunk(payload.as_py())
                depth, value = _depths(c, answers, longest, bits, owners)
                starts, found = _graph(c, depth, longest)
                owner = np.searchsorted(_cuts(bits, summing), value[starts], "right")
                yield _blocks(found, np.concatenate([owner, np.full(found.num_rows - len(owner), number % summing)]))

    answers = chunks.mapInArrow(send, _SENT).groupBy("owner").applyInArrow(_answer(least), _ANSWER)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))
    found = chunks.join(answers, "chunk", "left").select("chunk", "payload", "answers").mapInArrow(paths, _BLOCKS)
    return found.groupBy("owner").applyInArrow(_summed, _GRAMS)


def _first(gram: str, n: int | Column) -> Column:
    return F.call_function("substring_index", F.col(gram), F.lit(" "), F.lit(n) if isinstance(n, int) else n)


def phrase_counts(paths: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of up to ``longest`` words, (lang, phrase, size, f), and of all
    words, (lang, n).  Phrases under the paths' ``least`` may be too low or missing."""
    words = F.split("gram", " ")
    opened = F.when(F.col("size") > longest, F.transform(F.sequence(F.lit(1), F.col("size") - (longest - 1)), lambda i: F.array_join(F.slice(words, i, longest), " "))).otherwise(F.array("gram"))
    edges = paths.select("lang", F.explode(opened).alias("gram"), F.least("size", F.lit(longest)).alias("size"), "weight")
    edges = settle(edges.groupBy("lang", "gram", "size").agg(F.sum("weight").alias("weight")))
    # a phrase's flow: all longest grams that begin with it, those that end with it among them
    flow = edges.where("size > 0").select("lang", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: _first("gram", i))).alias("size", "phrase"), "weight")
    counts = flow.groupBy("lang", "phrase", (F.col("size") + 1).alias("size")).agg(F.sum("weight").alias("f"))
    return counts, edges.groupBy("lang").agg(F.sum("weight").alias("n"))


def collocations(df: DataFrame, column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = 2000, covered: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to
    ``longest`` words with ``least`` occurrences; those of which a longer one that holds them has
    ``covered`` percent of the occurrences are left out."""
    counts, totals = phrase_counts(weighted_paths(df, column, lang_column, longest, least, chunk), longest)
    counts = settle(counts.where(F.col("f") >= least))
    phrases = counts.where("size > 1").withColumnRenamed("f", "a")
    # the largest count of a longer phrase around each phrase
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    around = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    cuts = kept.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _first("phrase", F.col("k"))).withColumn("tail", _first("phrase", F.col("k") - F.col("size")))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
