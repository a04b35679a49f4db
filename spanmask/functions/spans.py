"""Span algebra as Spark Column expressions (no Python at run time).

A *span* is ``struct<start:int,end:int,label:string>`` with half-open code-point
offsets.  Everything here builds expressions evaluated inside one row, so a
document never leaves its partition: no shuffle, whole-stage codegen around the
regex calls, higher-order functions for the sequential folds.

Exact offsets without leaving the JVM: ``regexp_replace(text, p, M$0M)`` wraps
each match in the mark M, ``split`` on M yields alternating gap / match pieces,
and a fold over the piece lengths turns them into code-point offsets (Spark's
``length`` counts code points, like Python).  M is a noncharacter; where a text
holds it, the scanned copy has another noncharacter there.  No grammar tells the
two apart and the length stays, so every text has the same offsets either way.

Folds that append work in blocks (:func:`scan`) and slices of a long text are cut
from blocks of it (:func:`cut`), so the cost of a row grows with its length and
its number of spans, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate spans sort by (start, -length, detector priority) with the natural
# struct ordering, so the fields that decide the order come first.
CAND_TYPE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("neg_len", T.IntegerType()),
        T.StructField("prio", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)
CAND_ARRAY = T.ArrayType(CAND_TYPE)

SPAN_TYPE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)
SPAN_ARRAY = T.ArrayType(SPAN_TYPE)

KEPT_TYPE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("out_start", T.IntegerType()),
        T.StructField("out_end", T.IntegerType()),
    ]
)
KEPT_ARRAY = T.ArrayType(KEPT_TYPE)

RANGE_TYPE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RANGE_ARRAY = T.ArrayType(RANGE_TYPE)

# The mark around matches, and what stands for it in scanned text: two noncharacters,
# which never appear in interchanged text.
MARK, STAND_IN = chr(0xFDD0), chr(0xFDD1)

# Elements per block of a fold, code points per block of a long text.
_SCAN_BLOCK = 128
_TEXT_BLOCK = 1024
_WHOLE_BYTES = 4096


def empty(t: T.DataType) -> Column:
    return F.array().cast(t)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once and bound to the lambda variable v.

    Catalyst inlines a projected column into its consumer when it is referenced
    once there; references inside lambda bodies then re-evaluate it per element.
    Binding expensive inputs (span folds, masked texts) through a one-element
    ``transform`` keeps them computed once per row whatever the plan shape.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value``, marked so that Catalyst neither repeats it nor moves a filter below it.

    A filter on a span column would else be pushed under the projection that computes
    it, with a copy of the whole regex chain in it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def scan(xs: Column, state: dict[str, Column], out_type: T.ArrayType, step, finish=None) -> Column:
    """Fold over ``xs`` that appends to an array.

    ``step(state, x)`` gives the next state (a dict) and the array to append;
    ``finish(state)`` an array for the end.  Elements are taken in blocks: a block
    appends to its own short array, and the fold over the blocks collects those, so
    an append copies at most a block's output or the list of blocks.
    """
    names = list(state)

    def pick(acc):
        return [acc[n].alias(n) for n in names]

    def inside(acc, x):
        new, items = step(acc, x)
        return F.struct(*(new[n].alias(n) for n in names), F.concat(acc["out"], items).alias("out"))

    def block(acc, xs_block):
        start = F.struct(*pick(acc), empty(out_type).alias("out"))
        done = F.aggregate(xs_block, start, inside)
        return let(done, lambda d: F.struct(*pick(d), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def result(acc):
        if finish is None:
            return F.flatten(acc["outs"])
        return F.concat(F.flatten(acc["outs"]), finish(acc))

    def run(v):
        n = F.ceil(F.size(v) / F.lit(_SCAN_BLOCK)).cast("int")
        blocks = F.when(n > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: F.slice(v, i * _SCAN_BLOCK + 1, F.lit(_SCAN_BLOCK)),
        )).otherwise(F.array(v))
        zero = F.struct(*(c.alias(n) for n, c in state.items()), empty(T.ArrayType(out_type)).alias("outs"))
        return F.aggregate(blocks, zero, block, result)

    return let(xs, run)


def text_blocks(text: Column) -> Column:
    """Blocks of 1,024 code points of a long text; none for a short one."""
    return F.when(F.octet_length(text) <= _WHOLE_BYTES, empty(T.ArrayType(T.StringType()))).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _TEXT_BLOCK), F.lit(0))
    )


def cut(text: Column, blocks: Column, start: Column, n: Column) -> Column:
    """``n`` code points of ``text`` from ``start``; reads only the blocks they lie in."""
    first = F.floor(start / _TEXT_BLOCK).cast("int")
    last = F.least(F.floor((start + n - 1) / _TEXT_BLOCK).cast("int"), F.size(blocks) - 1)
    at = start % _TEXT_BLOCK + 1
    one = F.substring(F.get(blocks, first), at, n)
    many = F.concat(
        F.substring(F.get(blocks, first), at, F.lit(_TEXT_BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(F.get(blocks, last), F.lit(1), start + n - last * _TEXT_BLOCK),
    )
    return (
        F.when(F.size(blocks) == 0, F.substring(text, start + 1, n))
        .when((n <= 0) | (first >= F.size(blocks)), F.lit(""))
        .when(first >= last, one)
        .otherwise(many)
    )


def with_cut(text: Column, body) -> Column:
    """``body(t, slice)`` with the text and its blocks evaluated once; slice(start, n)."""
    return let(text, lambda t: let(text_blocks(t), lambda bl: body(t, lambda s, n: cut(t, bl, s, n))))


def pieces_around(text: Column, java_pattern: str, before: str = MARK, after: str = MARK) -> Column:
    """Split ``text`` at the marks put before and after each match."""
    safe = F.translate(text, MARK, STAND_IN)
    marked = F.regexp_replace(safe, F.lit(java_pattern), F.lit(f"{before}$0{after}"))
    return F.split(marked, MARK, -1)


def split_on_matches(text: Column, java_pattern: str) -> Column:
    """array<string>: gap, match, gap, match, ..., gap (odd positions are matches)."""
    return pieces_around(text, java_pattern)


def matches_to_cands(pieces: Column, label: Column, prio: Column, keep=None) -> Column:
    """Fold the piece array into candidate spans; ``keep(match)`` filters matches."""

    def step(acc, piece):
        n = F.length(piece)
        take = (acc["i"] % 2) == 1
        if keep is not None:
            take = take & keep(piece)
        span = F.struct(
            acc["pos"].alias("start"),
            (-n).alias("neg_len"),
            prio.alias("prio"),
            (acc["pos"] + n).alias("end"),
            label.alias("label"),
        )
        items = F.when(take, F.array(span)).otherwise(empty(CAND_ARRAY))
        return {"pos": acc["pos"] + n, "i": acc["i"] + 1}, items

    return scan(pieces, {"pos": F.lit(0), "i": F.lit(0)}, CAND_ARRAY, step)


def find_cands(text: Column, java_pattern: str, label: str, prio: int) -> Column:
    """All non-overlapping matches of one pattern as candidate spans."""
    return matches_to_cands(split_on_matches(text, java_pattern), F.lit(label), F.lit(prio))


def resolve(cands: Column) -> Column:
    """Leftmost-longest resolution (P2) with output coordinates.

    Sorted by (start, -length, detector order); a span is kept when it starts at
    or after the end of the last *kept* span.  ``out_start/out_end`` locate the
    placeholder in the masked text: start plus the running sum of
    (placeholder length - span length) over earlier kept spans.
    """

    def step(acc, s):
        ph = F.length(s["label"]) + 2
        out_start = s["start"] + acc["delta"]
        kept = F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["label"].alias("label"),
            out_start.alias("out_start"),
            (out_start + ph).alias("out_end"),
        )
        take = s["start"] >= acc["last"]
        new = {
            "last": F.when(take, s["end"]).otherwise(acc["last"]),
            "delta": F.when(take, acc["delta"] + ph - (s["end"] - s["start"])).otherwise(acc["delta"]),
        }
        return new, F.when(take, F.array(kept)).otherwise(empty(KEPT_ARRAY))

    return scan(F.array_sort(cands), {"last": F.lit(-1), "delta": F.lit(0)}, KEPT_ARRAY, step)


def mask(text: Column, kept: Column, placeholder=None) -> Column:
    """Replace each kept span (sorted, disjoint) by ``[LABEL]``."""
    placeholder = placeholder or (lambda label: F.concat(F.lit("["), label, F.lit("]")))

    def build(t, part, ks):
        def piece(k, i):
            prev_end = F.when(i == 0, F.lit(0)).otherwise(F.get(ks, i - 1)["end"])
            return F.concat(part(prev_end, k["start"] - prev_end), placeholder(k["label"]))

        tail_from = F.get(ks, F.size(ks) - 1)["end"]
        return F.concat(F.array_join(F.transform(ks, piece), ""), part(tail_from, F.length(t) - tail_from))

    # a text without spans is not cut into blocks
    return let(kept, lambda ks: F.when(F.size(ks) == 0, text).otherwise(with_cut(text, lambda t, part: build(t, part, ks))))


def label_counts(labels: Column) -> Column:
    """map<label,int> over an array of labels; only labels that occur (P5)."""

    def count(ls):
        return F.map_from_entries(F.transform(
            F.array_distinct(ls),
            lambda l: F.struct(l.alias("key"), F.size(F.filter(ls, lambda x: x == l)).alias("value")),
        ))

    return let(labels, count)


def covered_ranges(kept: Column) -> Column:
    """array<struct<start,end>> of placeholder ranges in the output text."""
    return F.transform(kept, lambda k: F.struct(k["out_start"].alias("start"), k["out_end"].alias("end")))


def explode_rows(df, array_col: str, alias: str, *keep):
    """Rows of ``array_col`` (none for an empty array), as ``alias``.

    ``explode`` would make Catalyst infer ``size(array) > 0`` and push it below
    the projections that compute the array, evaluating the whole regex/fold
    chain again inside the filter; ``explode_outer`` plus a filter on the
    generated column keeps the chain computed once.
    """
    out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    return out.where(F.col(alias).isNotNull())


def posexplode_rows(df, array_col: str, pos: str, alias: str, *keep):
    """Like :func:`explode_rows` with the element position as ``pos``."""
    out = df.select(*keep, F.posexplode_outer(array_col).alias(pos, alias))
    return out.where(F.col(alias).isNotNull())
