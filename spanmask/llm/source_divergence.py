"""How far the sources of a language differ in their terms, by count-level bitmaps.

Each (language, source) group holds, per number of occurrences, the set of the terms that it
uses so often, as bits over the language's kept terms.  ANDing two groups' sets and counting
bits gives how many terms fall into each pair of counts (the joint cells); each cell is
multiplied by the divergence f of its two rates.  Cells of count 0 are never stored: they are
the complement, so every term adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) where both groups
use it, f(p, q0) - f(p0, q0) for each side's use, and f(p0, q0) once whatever its counts.

Terms are dealt to blocks of about ``BLOCK`` ids by a hash, and within a block ordered by
frequency, so that sets of one count stay within few words of 64 bits; only words that hold a
bit are stored.  A block of terms and ``TILE`` x ``TILE`` sources make one task's group, whatever
the size of the corpus, of a language or of a source.  Occurrences are summed per task before
they are shuffled.

Null text, lang and source: ''.  Texts without terms and groups without kept terms count as
groups.  Repeated rows count each.  A language in which no term is kept has its pairs with
value 0.  Empty tables give empty results.  Columns other than the three named are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.llm.blocks import settle

BLOCK, TILE = 2048, 64
#: Entries (term of a group) that a task holds before it hands them on.
HELD = 1 << 18
SLICE = 4 << 20
SCALE = 1_000_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# in UTF-8 every byte of a character beyond U+007F is 0x80 or more
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def _terms(text: bytes) -> Counter:
    """Occurrences of each term of a whole text, read in slices that end between terms."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        found.update(_TERM.findall(text, at, end))
        at = max(end, at + 1)
    return found


def _batch(held: dict) -> pa.RecordBatch:
    lang, source, term, n, df = [], [], [], [], []
    for (of_lang, of_source), counts in held.items():
        lang += [of_lang] * (len(counts) + 1)
        source += [of_source] * (len(counts) + 1)
        term += [None, *counts]
        n += [0, *(c[0] for c in counts.values())]
        df += [0, *(c[1] for c in counts.values())]
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count(batches):
    """(lang, source, term, n, docs) of the task's rows; a null term stands for its group."""
    held, size = {}, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            group = held.setdefault((lang, source), {})
            before = len(group)
            for term, n in _terms(text.as_py().translate(_LOWER)).items():
                have = group.get(term)
                if have is None:
                    group[term] = [n, 1]
                else:
                    have[0] += n
                    have[1] += 1
            size += len(group) - before
            if size >= HELD:
                yield _batch(held)
                held, size = {}, 0
    if held:
        yield _batch(held)


def term_counts(df: DataFrame, column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the kept terms, those in at least ``least_docs``
    texts of their language; ``first`` is 1 in one row of each (lang, term).  One row with null
    term per group, so that groups without terms are there."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((column, "text"), (lang_column, "lang"), (source_column, "source"))))
    # sums per task go to their term's partition at once; what follows needs no other shuffle
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # one row per source in each of these windows
    term = Window.partitionBy("lang", "term")
    counted = counted.select("lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"), F.sum("docs").over(term).alias("docs"), F.row_number().over(term.orderBy("source")).alias("nth"))
    kept = counted.where(F.col("term").isNull() | (F.col("docs") >= least_docs))
    first = ((F.col("nth") == 1) & F.col("term").isNotNull()).cast("long")
    return kept.select("lang", "source", "term", "n", "n_lang", first.alias("first"))


def rate(n: str | Column, total: str, kept: str = "v") -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact beyond 64 bits."""
    n, total = (F.col(c) if isinstance(c, str) else c for c in (n, total))
    up = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = F.greatest(total + 2 * F.col(kept), F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _joint(table: pa.Table) -> pa.Table:
    """Sums of f over one block's terms for all pairs of sources of two tiles."""
    lang, block, low, high = (table.column(c)[0].as_py() for c in ("lang", "block", "low", "high"))
    table = table.sort_by([("place", "ascending"), ("word", "ascending")])
    place, tile, word, p, bits, v = (table.column(c).to_numpy() for c in ("place", "tile", "word", "p", "bits", "v"))
    bits = bits.view(np.uint64)
    heads = np.flatnonzero(word < 0)
    bounds = np.append(heads, len(place))
    # per source: its place, tile, rate of count 0, and its entries
    sources = [(place[h], tile[h], p[h], slice(h + 1, e)) for h, e in zip(heads, bounds[1:], strict=True)]
    ones = np.bitwise_count(bits).astype(np.int64)
    out = []
    for i, (a, tile_a, p0, mine) in enumerate(sources):
        if tile_a != low:
            continue
        for b, tile_b, q0, other in sources[i + 1 :]:
            if tile_b != high:
                continue
            both = int(_f(p0, q0))
            p_q0, p0_q = _f(p[mine], q0), _f(p0, p[other])
            value = int((ones[mine] * (p_q0 - both)).sum()) + int((ones[other] * (p0_q - both)).sum())
            if block == 0:
                value += int(v[0]) * both
            # entries of one word of ids meet each other
            lo, hi = np.searchsorted(word[other], word[mine], "left"), np.searchsorted(word[other], word[mine], "right")
            n = hi - lo
            left = np.repeat(np.arange(len(n)), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - lo, n)
            cell = np.bitwise_count(bits[mine][left] & bits[other][right]).astype(np.int64)
            met = cell > 0
            left, right, cell = left[met], right[met], cell[met]
            value += int((cell * (_f(p[mine][left], p[other][right]) - p_q0[left] - p0_q[right] + both)).sum())
            if value or block == 0:
                out.append((a, b, value))
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})


def _totals(counts: DataFrame) -> DataFrame:
    """One row per group: total (its n), v and total_lang (kept terms and their n in the
    language), place and tile among the language's sources, their number, and its tiles."""
    by_lang = Window.partitionBy("lang")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("v"))
    groups = groups.select("lang", "source", "total", F.sum("v").over(by_lang).alias("v"), F.sum("total").over(by_lang).alias("total_lang"), (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(by_lang).alias("sources"))
    return groups.select("*", F.floor(F.col("place") / TILE).cast("int").alias("tile"), F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"), F.greatest(F.ceil(F.col("v") / BLOCK), F.lit(1)).cast("long").alias("blocks"))


def bitmaps(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, place, n, block, word, bits): the terms that a group uses n times, 64 ids a row."""
    of = groups.select("lang", "source", "place", "blocks")
    terms = counts.where(F.col("term").isNotNull()).join(of, ["lang", "source"])
    terms = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    # about BLOCK terms, each in one row per source
    at = F.dense_rank().over(Window.partitionBy("lang", "block").orderBy(F.desc("n_lang"), "term")) - 1
    terms = terms.withColumn("id", at)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))
    return terms.groupBy("lang", "block", "place", "n", F.floor(F.col("id") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    of = groups.select("lang", "place", "tile", "tiles", "total", "v")
    sets = bitmaps(counts, groups).join(of, ["lang", "place"]).select("lang", "block", "place", "tile", "tiles", "word", "bits", rate("n", "total").alias("p"), "v")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "place", "tile", "tiles", F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"), rate(F.lit(0), "total").alias("p"), "v")
    with_tile = sets.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = with_tile.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "place", "tile", "word", "bits", "p", "v")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_joint, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # f is the same both ways
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair"), "value").select("lang", "pair.*", "value")
    name = groups.select("lang", "place", "source")
    named = both.join(name.withColumnRenamed("place", "a"), ["lang", "a"])
    return named.join(name.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a group uses more than its language does."""
    terms = counts.where((F.col("n") > 0) & F.col("term").isNotNull()).join(groups.select("lang", "source", "total", "total_lang", "v"), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), rate("n", "total").alias("p"), rate("n_lang", "total_lang").alias("q")).where("p > q")
    return terms.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(df: DataFrame, column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources (part ``pair``) and the
    ``top`` terms that tell a source from its language (part ``term``)."""
    counts = settle(term_counts(df, column, lang_column, source_column, least_docs))
    groups = settle(_totals(counts))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = term_values(counts, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
