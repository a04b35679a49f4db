"""Contextual layer: entity scoring and masking.

A model works on chunk rows (key, chunk_idx, cstart, text), spread over all tasks, so one
long document is scored by many of them; it gets Arrow batches of texts, is loaded once per
worker (E4), and a failing text only records its error type (E3): a batch that raises is
halved until the text at fault stands alone.  Hits alone travel back to their documents.

A dictionary whose size is checked and small becomes an automaton that reads each document's
chunks in its own row, without any shuffle; a larger one is a table and the match a join.

Merging (P7), the covered guard (P8) and masking (P9) are Column expressions; table forms of
the same operators are in :mod:`spanmask.operators.span_tables`.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.rowwise import segment_chunks
from ..functions.spans import empty, once, scan, split_on_matches, with_cut

# One row per scored chunk (scored = 1, its error if it failed) and one per hit (scored = 0).
SCORED_FIELDS = "key binary, chunk_idx int, cstart int, scored int, error string, hit_idx int, label_idx int, start int, end int, label string, text string, confidence double"

# Sort key for merging: position, longer first, then the scoring order.
ESPAN_TYPE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("neg_len", T.IntegerType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("label_idx", T.IntegerType()),
        T.StructField("hit_idx", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)
ESPAN_ARRAY = T.ArrayType(ESPAN_TYPE)


# ---- scorers (E1) ---------------------------------------------------------------
class Scorer:
    """Protocol of a pluggable entity model.

    ``load()`` runs once per Python worker.  ``score_batch(model, texts, labels,
    threshold)`` returns for each text its hits, dicts with ``label``, ``start``,
    ``end`` (chunk-local code points), ``text`` and ``confidence``, or the exception
    that this text raised.  A scorer that takes one text at a time gives
    ``score(model, text, labels, threshold)`` instead.
    """

    name = "scorer"
    batch_size = 64

    def load(self):
        return None

    def score(self, model, text: str, labels: Sequence[str], threshold: float) -> list[dict]:
        raise NotImplementedError

    def score_batch(self, model, texts: Sequence[str], labels: Sequence[str], threshold: float) -> list:
        out = []
        for text in texts:
            try:
                out.append(self.score(model, text, labels, threshold))
            except Exception as exc:  # noqa: BLE001 - a failing text adds no spans (E3)
                out.append(exc)
        return out

    def scored(self, chunks: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
        """Rows of SCORED_FIELDS for chunk rows that are not blank."""
        return _model_scored(self, chunks, labels, threshold)

    def in_row(self, labels: Sequence[str], threshold: float, size: int, overlap: int) -> Callable[[Column, Column], Column] | None:
        """For scorers so cheap that a document is scored where it is: a function of the text
        and its covered ranges that chunks what is not covered and gives the ROW_SCORED
        struct.  None: score chunk rows."""
        return None


# Per Python worker: each scorer's model, by a key fixed when the query is built.
_MODELS: dict[str, object] = {}


def _model_for(scorer: Scorer, key: str):
    if key not in _MODELS:
        _MODELS[key] = scorer.load()
    return _MODELS[key]


def _cache_key(scorer: Scorer) -> str:
    # a scorer may name a stable key (e.g. its model id) to share its model across queries
    return getattr(scorer, "cache_key", None) or uuid.uuid4().hex


def score_apart(scorer: Scorer, model, texts: Sequence[str], labels: Sequence[str], threshold: float) -> list:
    """Per text its hits or its exception: a batch that raises is halved until the texts at
    fault stand alone, so a text loses nothing by those beside it (E3)."""
    try:
        found = list(scorer.score_batch(model, texts, labels, threshold))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return found
    except Exception as exc:  # noqa: BLE001 - the text fails, not the job
        if len(texts) == 1:
            return [exc]
        half = len(texts) // 2
        return [*score_apart(scorer, model, texts[:half], labels, threshold), *score_apart(scorer, model, texts[half:], labels, threshold)]


def _numbered(found: Sequence[dict], order: dict[str, int]):
    """Per hit: its number among the hits of its label, the label's place, and the hit."""
    seen: dict[str, int] = {}
    for h in found:
        n = seen[h["label"]] = seen.get(h["label"], -1) + 1
        yield n, order.get(h["label"], len(order)), h


_SCORED_ARROW = pa.schema([
    ("key", pa.binary()), ("chunk_idx", pa.int32()), ("cstart", pa.int32()), ("scored", pa.int32()), ("error", pa.string()), ("hit_idx", pa.int32()),
    ("label_idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("confidence", pa.float64())])


def _model_scored(scorer: Scorer, chunks: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
    labels = list(labels)
    order = {lab: i for i, lab in enumerate(labels)}
    cache_key = _cache_key(scorer)

    def chunk_rows(chunk, found):
        if isinstance(found, Exception):
            return [(*chunk, 1, type(found).__name__, *[None] * 7)]
        hits = [(*chunk, 0, None, n, place, int(h["start"]), int(h["end"]), h["label"], h.get("text") or "", float(h.get("confidence", 1.0)))
                for n, place, h in _numbered(found, order)]
        return [(*chunk, 1, None, *[None] * 7), *hits]

    def run(batches):
        model = _model_for(scorer, cache_key)
        for batch in batches:
            for lo in range(0, batch.num_rows, scorer.batch_size):
                part = batch.slice(lo, scorer.batch_size).to_pydict()
                found = score_apart(scorer, model, part["text"], labels, threshold)
                rows = [r for *chunk, f in zip(part["key"], part["chunk_idx"], part["cstart"], found, strict=True) for r in chunk_rows(chunk, f)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCORED_ARROW, strict=True)], schema=_SCORED_ARROW)

    return chunks.select("key", "chunk_idx", "cstart", "text").mapInArrow(run, SCORED_FIELDS)


# Result of scoring a document in its row: chunks, those scored, and their hits with the start
# of the chunk that their offsets count from.
ROW_HIT = "struct<chunk_idx:int,cstart:int,hit_idx:int,label_idx:int,start:int,end:int,label:string,text:string,confidence:double>"
ROW_SCORED = f"struct<chunks:int,scored:int,hits:array<{ROW_HIT}>>"
_HIT_ARROW = pa.struct([
    ("chunk_idx", pa.int32()), ("cstart", pa.int32()), ("hit_idx", pa.int32()), ("label_idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("label", pa.string()), ("text", pa.string()), ("confidence", pa.float64())])
_ROW_ARROW = pa.struct([("chunks", pa.int32()), ("scored", pa.int32()), ("hits", pa.list_(_HIT_ARROW))])

#: Hits, or documents, after which those of a batch that are still Python objects become Arrow.
_PACK_HITS, _PACK_ROWS = 4096, 512


def _packed_rows(rows: Iterable[tuple[int, int, list[tuple]]]) -> Iterator[pa.Array]:
    """Arrays of ROW_SCORED for (chunks, scored, hits in the order of ROW_HIT): at no time are
    more hits held as Python objects than ``_PACK_HITS`` and those of one document."""

    def packed():
        columns = list(zip(*found, strict=True)) or [()] * len(_HIT_ARROW)
        hits = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT_ARROW, strict=True)], fields=list(_HIT_ARROW))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
        return pa.StructArray.from_arrays([pa.array(chunks, pa.int32()), pa.array(scored, pa.int32()), lists.cast(_ROW_ARROW[2].type)], fields=list(_ROW_ARROW))

    chunks, scored, ends, found = [], [], [0], []
    for n, m, hits in rows:
        chunks.append(n)
        scored.append(m)
        found += hits
        ends.append(len(found))
        if len(found) >= _PACK_HITS or len(chunks) >= _PACK_ROWS:
            yield packed()
            chunks, scored, ends, found = [], [], [0], []
    yield packed()


def _row_scored(scorer: Scorer, labels: Sequence[str], threshold: float, size: int, overlap: int) -> Callable[[Column, Column], Column]:
    """``Scorer.in_row`` of a scorer that raises on no text."""
    labels = list(labels)
    order = {lab: i for i, lab in enumerate(labels)}
    cache_key = _cache_key(scorer)

    def row(model, text, ranges):
        chunks = segment_chunks(text or "", [(r["start"], r["end"]) for r in ranges or ()], size, overlap)
        parts = [(i, start, text[start:end]) for i, (start, end) in enumerate(chunks)]
        parts = [p for p in parts if not p[2].isspace()]
        found = scorer.score_batch(model, [p[2] for p in parts], labels, threshold)
        return len(chunks), len(parts), [
            (i, start, n, place, h["start"], h["end"], h["label"], h["text"], h["confidence"])
            for (i, start, _), f in zip(parts, found, strict=True) for n, place, h in _numbered(f, order)]

    @F.arrow_udf(ROW_SCORED)
    def run(texts: pa.Array, covered: pa.Array) -> pa.Array:
        model = _model_for(scorer, cache_key)
        # a batch's texts are Python strings one at a time
        return pa.concat_arrays(list(_packed_rows(row(model, text.as_py(), ranges.as_py()) for text, ranges in zip(texts, covered, strict=True))))

    return lambda text, covered: run.asNondeterministic()(text, covered)


@dataclass
class AutomatonScorer(Scorer):
    """Occurrences of terms (term, label, confidence) at word boundaries, by one automaton with
    failure links, in time linear in the text and its hits."""

    entries: list[tuple[str, str, float]] | bytes
    name: str = "dictionary"

    def __getstate__(self):
        # every task reads this, but only a worker without the automaton unpacks the terms
        if isinstance(self.entries, bytes):
            return self.__dict__
        values = list(dict.fromkeys((c, label) for _, label, c in self.entries))
        at = {v: i for i, v in enumerate(values)}
        return self.__dict__ | {"entries": pickle.dumps((values, [e[0] for e in self.entries], array("I", [at[c, label] for _, label, c in self.entries])))}

    def _by_term(self) -> dict[str, tuple[tuple[float, str], ...]]:
        """Terms with their sorted (confidence, label); terms with the same ones share them."""
        values, terms, at = pickle.loads(self.entries if isinstance(self.entries, bytes) else self.__getstate__()["entries"])
        shared: dict[tuple[int, ...], tuple] = {}
        ids: dict[str, tuple[int, ...]] = {}
        for term, i in zip(terms, at, strict=True):
            ids[term] = (*ids.get(term, ()), i)
        return {term: shared.setdefault(v, tuple(sorted(values[i] for i in v))) for term, v in ids.items()}

    def load(self):
        import ahocorasick

        by_term = self._by_term()
        found = ahocorasick.Automaton()
        for term, values in by_term.items():
            found.add_word(term, (term, values, _in_word(term[0]), _in_word(term[-1])))
        if by_term:
            found.make_automaton()
        return found

    def score(self, model, text, labels, threshold):
        if not len(model):
            return []
        out, n = [], len(text)
        for last, (term, values, opens, closes) in model.iter(text):
            start, end = last + 1 - len(term), last + 1
            if (opens and start and _in_word(text[start - 1])) or (closes and end < n and _in_word(text[end])):
                continue
            out += [(start, end, term, confidence, label) for confidence, label in values]
        return [{"label": label, "start": start, "end": end, "text": term, "confidence": confidence} for start, end, term, confidence, label in sorted(out)]

    def in_row(self, labels, threshold, size, overlap):
        return _row_scored(self, labels, threshold, size, overlap)


def _in_word(c: str) -> bool:
    """Python's word characters."""
    return c.isalnum() or c == "_"


_TOKEN = f"[{P.JAVA_WORD_BODY}]+|[^{P.JAVA_SPACE_BODY}]"
TOKEN_ARRAY = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]))


def tokens(text: Column) -> Column:
    """array<struct<pos, token>>: runs of word characters, and other single characters that
    are not space."""

    def step(acc, piece):
        item = F.struct(acc["pos"].alias("pos"), piece.alias("token"))
        return {"pos": acc["pos"] + F.length(piece), "i": acc["i"] + 1}, F.when(acc["i"] % 2 == 1, F.array(item)).otherwise(empty(TOKEN_ARRAY))

    return scan(split_on_matches(text, _TOKEN), {"pos": F.lit(0), "i": F.lit(0)}, TOKEN_ARRAY, step)


#: Bits of the filter of first tokens, as words of 64.
_FIRST_WORDS = 1 << 16


def _token_bits(token: Column) -> list[Column]:
    """The filter's bits of a token."""
    return [F.pmod(F.shiftrightunsigned(F.xxhash64(token), shift), F.lit(64 * _FIRST_WORDS)) for shift in (0, 32)]


def first_tokens(terms: DataFrame) -> Column:
    """Bloom filter of the terms' first tokens: one array of fixed size, as a scalar subquery."""
    bit = terms.select(F.explode(F.array(*_token_bits(F.col("token")))).alias("bit"))
    words = bit.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    every = terms.sparkSession.range(_FIRST_WORDS).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    array = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b"))
    return array.select(F.transform("b", lambda x: x["bits"])).scalar()


def may_be_first(token: Column, bits: Column) -> Column:
    return F.forall(F.array(*_token_bits(token)), lambda b: F.getbit(F.get(bits, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)


@dataclass
class DictionaryScorer(Scorer):
    """Every occurrence of a dictionary term at word boundaries.

    ``terms`` is a table (term, label, confidence) of any size.  Its usable terms are counted
    when the query is built.  Up to ``automaton_chars`` characters in all, they become one
    automaton in the Python workers (0: never).  Beyond that the match is a join: tokens that a
    Bloom filter of the terms' first tokens lets through, with as much text after them as the
    longest term has, meet the terms that start with them.  Terms that start with space match
    nothing.  Both ways give the same hits.
    """

    terms: DataFrame
    name: str = "dictionary"
    automaton_chars: int = 4_000_000
    _small: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_table(cls, spark, terms: DataFrame) -> DictionaryScorer:
        return cls(terms)

    def usable(self, labels: Sequence[str], threshold: float) -> DataFrame:
        """(term, label, confidence, size, token): terms that can give a hit."""
        # a term is computed once, not again in each filter on it: it may come from a whole text
        terms = self.terms.select(once(F.col("term")).alias("term"), "label", "confidence").where(F.length("term") > 0).select(
            F.col("term"), F.col("label"), F.col("confidence").cast("double").alias("confidence"),
            F.length("term").alias("size"), F.regexp_extract("term", f"^(?:{_TOKEN})", 0).alias("token"))
        return terms.where(F.col("label").isin(list(labels)) & (F.col("confidence") >= F.lit(threshold)) & (F.col("token") != ""))

    def automaton(self, labels: Sequence[str], threshold: float) -> AutomatonScorer | None:
        """The dictionary as an automaton, if it is small enough."""
        key = (tuple(labels), threshold)
        if key not in self._small and self.automaton_chars:
            # kept on disk between counting and collecting: what makes the terms runs once
            terms = self.usable(labels, threshold).select("term", "label", "confidence", "size").persist(StorageLevel.DISK_ONLY)
            try:
                size = terms.agg(F.sum(F.col("size") + 1)).first()[0] or 0
                rows = terms.select("term", "label", "confidence").collect() if size <= self.automaton_chars else None
            finally:
                terms.unpersist()
            self._small[key] = None if rows is None else AutomatonScorer([tuple(r) for r in rows], self.name)
        return self._small.get(key)

    def in_row(self, labels, threshold, size, overlap):
        small = self.automaton(labels, threshold)
        return small and small.in_row(labels, threshold, size, overlap)

    def scored(self, chunks: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
        small = self.automaton(labels, threshold)
        return small.scored(chunks, labels, threshold) if small else self._joined(chunks, labels, threshold)

    def _joined(self, chunks: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
        order = F.array(*(F.lit(x) for x in labels))
        word = f"[{P.JAVA_WORD_BODY}]$"
        terms = self.usable(labels, threshold)
        longest = terms.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).scalar()
        bits, reach = F.col("__spanmask_first"), F.col("__spanmask_longest") + 1
        around = with_cut(F.col("text"), lambda t, part: F.transform(
            F.filter(tokens(t), lambda k: may_be_first(k["token"], bits)),
            lambda k: F.struct(k["pos"].alias("pos"), k["token"].alias("token"), part(k["pos"], reach).alias("rest"))))
        at = chunks.withColumn("__spanmask_longest", longest).withColumn("__spanmask_first", first_tokens(terms))
        at = at.select("key", "chunk_idx", "cstart", F.explode_outer(around).alias("k"))
        at = at.select("key", "chunk_idx", "cstart", F.col("k.pos").alias("pos"), F.col("k.token").alias("token"), F.col("k.rest").alias("rest"))
        met = at.join(terms, "token").where(
            (F.substring("rest", F.lit(1), F.col("size")) == F.col("term"))
            & ~(F.col("term").rlike(word) & F.substring("rest", F.col("size") + 1, F.lit(1)).rlike(word)))
        nth = F.row_number().over(Window.partitionBy("key", "chunk_idx", "label").orderBy("pos", "size", "term", "confidence"))
        hits = met.select(
            "key", "chunk_idx", "cstart", F.lit(0).alias("scored"), F.lit(None).cast("string").alias("error"),
            (nth - 1).alias("hit_idx"), (F.array_position(order, F.col("label")) - 1).cast("int").alias("label_idx"),
            F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"), "label", F.col("term").alias("text"), "confidence")
        done = chunks.select(
            "key", "chunk_idx", "cstart", F.lit(1).alias("scored"), F.lit(None).cast("string").alias("error"),
            *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SCORED_FIELDS.split(", ")[5:]))
        return done.unionByName(hits)


@dataclass
class PatternScorer(Scorer):
    """Regular expressions (Python's) as a batch model: label -> (pattern, confidence).

    Like a model of limited width it takes no text of more than ``max_chars``: such a text
    fails the batch that holds it, and so, batches being halved, itself alone."""

    patterns: dict[str, tuple[str, float]]
    max_chars: int | None = None
    name: str = "patterns"

    def load(self):
        import re

        return [(label, re.compile(pattern), confidence) for label, (pattern, confidence) in self.patterns.items()]

    def score_batch(self, model, texts, labels, threshold):
        for text in texts:
            if self.max_chars is not None and len(text) > self.max_chars:
                raise ValueError(f"text of {len(text)} characters")
        known = [m for m in model if m[0] in labels and m[2] >= threshold]
        return [[{"label": label, "start": m.start(), "end": m.end(), "text": m[0], "confidence": confidence}
                 for label, pattern, confidence in known for m in pattern.finditer(text)] for text in texts]


# ---- filters (V4, V5, E2) --------------------------------------------------------
_EDGE_SPACE = f"^[{P.JAVA_SPACE_BODY}]+|[{P.JAVA_SPACE_BODY}]+$"


def entity_word(text: Column) -> Column:
    """A hit's text as it is compared with the stopwords: without space around it, lower case."""
    return F.lower(F.regexp_replace(text, _EDGE_SPACE, ""))


def confident(threshold: float) -> Column:
    return F.col("confidence") >= F.lit(threshold)


def known_label(labels: Sequence[str] = P.ENTITY_LABELS) -> Column:
    return F.col("label").isin(list(labels))


def is_stopword(text: Column) -> Column:
    return entity_word(F.coalesce(text, F.lit(""))).isin(list(P.ENTITY_STOPWORDS))


def not_stopword() -> Column:
    return ~is_stopword(F.col("text"))


def filter_hits(hits: DataFrame, threshold: float, labels: Sequence[str] = P.ENTITY_LABELS) -> DataFrame:
    """V4 + E2 + V5: confident hits of a known label that are not stopwords."""
    return hits.where(confident(threshold) & known_label(labels) & not_stopword())


def remap(hits: DataFrame) -> DataFrame:
    """Chunk-local offsets -> offsets in the scored text (P10)."""
    return hits.withColumn("start", F.col("start") + F.col("cstart")).withColumn("end", F.col("end") + F.col("cstart"))


def _espan(start: Column, end: Column, hit) -> Column:
    return F.struct(
        start.alias("start"), (start - end).alias("neg_len"), hit("chunk_idx").alias("chunk_idx"), hit("label_idx").alias("label_idx"),
        hit("hit_idx").alias("hit_idx"), end.alias("end"), hit("label").alias("label")).cast(ESPAN_TYPE)


def gather(scored: DataFrame, threshold: float, labels: Sequence[str] = P.ENTITY_LABELS) -> DataFrame:
    """Per key: ``scored_chunks``, ``model_errors`` and ``hits`` (kept ones, as ESPAN structs)."""
    keep = confident(threshold) & known_label(labels) & not_stopword()
    span = _espan(F.col("start"), F.col("end"), F.col)
    return remap(scored).groupBy("key").agg(
        F.sum("scored").cast("int").alias("scored_chunks"),
        F.collect_list("error").alias("model_errors"),
        F.collect_list(F.when(F.col("start").isNotNull() & keep, span)).alias("hits"),
    )


def kept_in_row(hits: Column, threshold: float, labels: Sequence[str] = P.ENTITY_LABELS) -> Column:
    """V4, V5, E2 and P10 on the hits of a ROW_SCORED struct: ESPAN structs."""
    def keep(h):
        return (h["confidence"] >= F.lit(threshold)) & h["label"].isin(list(labels)) & ~is_stopword(h["text"])

    def span(h):
        return _espan(h["start"] + h["cstart"], h["end"] + h["cstart"], lambda n: h[n])

    return F.transform(F.filter(hits, keep), span)


# ---- in-row span operators (P7, P8, P9) -------------------------------------------
def merge_contained(spans: Column) -> Column:
    """Sort, then drop a span fully inside the last kept one."""

    def step(acc, s):
        drop = (s["start"] < acc["m"]) & (s["end"] <= acc["m"])
        return {"m": F.greatest(acc["m"], s["end"])}, F.when(drop, empty(ESPAN_ARRAY)).otherwise(F.array(s))

    return scan(F.array_sort(spans), {"m": F.lit(-1)}, ESPAN_ARRAY, step)


def guard(spans: Column, covered: Column) -> Column:
    """Drop spans that touch a covered range.

    One walk over both: ranges and spans are merged by their start.  Covered ranges
    are disjoint, so a span touches one if the last range that starts before the
    span's end ends after the span's start; that range is the next one, or one
    already passed.  Sorted by end for the spans and by start for the ranges, each
    span meets exactly the ranges that start before its end.
    """
    events = F.concat(
        F.transform(covered, lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("kind"), c["end"].alias("end"), F.lit(None).cast(ESPAN_TYPE).alias("span"))),
        F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("kind"), s["start"].alias("end"), s.alias("span"))),
    )

    def step(acc, e):
        is_range = e["kind"] == 1
        clear = ~is_range & (e["end"] >= acc["reach"])
        return {"reach": F.when(is_range, F.greatest(acc["reach"], e["end"])).otherwise(acc["reach"])}, F.when(clear, F.array(e["span"])).otherwise(empty(ESPAN_ARRAY))

    return F.array_sort(scan(F.array_sort(events), {"reach": F.lit(0)}, ESPAN_ARRAY, step))


def greedy(spans: Column) -> Column:
    """P9 walk over sorted spans: skip a span starting before the cursor."""

    def step(acc, s):
        skip = s["start"] < acc["cur"]
        return {"cur": F.when(skip, acc["cur"]).otherwise(s["end"])}, F.when(skip, empty(ESPAN_ARRAY)).otherwise(F.array(s))

    return scan(spans, {"cur": F.lit(0)}, ESPAN_ARRAY, step)


def upper_placeholder(label: Column) -> Column:
    return F.concat(F.lit("["), F.upper(label), F.lit("]"))
