"""Chunking as Column expressions.

Ranges are ``struct<start:int,end:int>`` with code-point offsets into the text
the expression was given.  Units come from the split at marks (separator kept
with the piece on its left), hard windows from ``sequence``, and packing is one
blocked fold over the units.  Recursion depth is fixed by the unit rules:

* text that fits -> one range;
* paragraph units if the text has a paragraph break, else sentence units, else
  none; a single unit equal to the whole text -> hard windows;
* an oversize unit that still holds its separator (every unit but the tail)
  would split into itself again -> hard windows; the oversize tail paragraph is
  the only unit that descends to sentence packing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .spans import RANGE_ARRAY, empty, let, pieces_around, scan, with_cut


def _rng(s: Column, e: Column) -> Column:
    return F.struct(s.alias("start"), e.alias("end"))


def unit_ranges(text: Column, java_sep: str, base: Column | None = None) -> Column:
    """Units split after each separator match; empty tail dropped.

    Returns ranges shifted by ``base``; a text without separator gives one unit.
    """
    base = F.lit(0) if base is None else base

    def step(acc, p):
        end = acc["pos"] + F.length(p)
        return {"pos": end}, F.when(end > acc["pos"], F.array(_rng(acc["pos"], end))).otherwise(empty(RANGE_ARRAY))

    return scan(pieces_around(text, java_sep, before=""), {"pos": base}, RANGE_ARRAY, step)


def hard_windows(s: Column, e: Column, size: int, overlap: int) -> Column:
    """Fixed windows over [s, e): step max(1, size-overlap), last one clipped."""
    step = max(1, size - overlap)
    n = e - s
    count = F.when(n <= 0, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")) + 1
    )
    ks = F.sequence(F.lit(0), count - 1)
    return F.when(count == 0, empty(RANGE_ARRAY)).otherwise(
        F.transform(ks, lambda k: _rng(s + k * step, F.least(s + k * step + size, e)))
    )


def pack(units: Column, size: int, oversize) -> Column:
    """First-fit packing of contiguous units up to ``size`` (C4).

    ``oversize(u)`` gives the ranges that replace a unit longer than ``size``.
    """

    def flushed(acc):
        return F.when(acc["cur"] > acc["buf"], F.array(_rng(acc["buf"], acc["cur"]))).otherwise(empty(RANGE_ARRAY))

    def step(acc, u):
        fits = (u["end"] - acc["buf"]) <= size
        big = (u["end"] - u["start"]) > size
        new = {
            "cur": u["end"],
            "buf": F.when(fits, acc["buf"]).when(big, u["end"]).otherwise(u["start"]),
        }
        return new, F.when(fits, empty(RANGE_ARRAY)).when(big, F.concat(flushed(acc), oversize(u))).otherwise(flushed(acc))

    # the fold is seeded with (0, 0): units must start at 0 for the seed to be right
    return scan(units, {"cur": F.lit(0), "buf": F.lit(0)}, RANGE_ARRAY, step, flushed)


def _sentence_level(sub: Column, s: Column, size: int, overlap: int) -> Column:
    """Chunks of the text ``sub`` (no paragraph break inside) by sentence packing,
    shifted by ``s``."""

    def chunks(units):
        # packing's seed assumes units start at 0: pack in local coordinates, then shift
        packed = pack(units, size, lambda u: hard_windows(u["start"], u["end"], size, overlap))
        whole = hard_windows(F.lit(0), F.element_at(units, -1)["end"], size, overlap)
        return F.transform(
            F.when(F.size(units) == 1, whole).otherwise(packed),
            lambda r: _rng(r["start"] + s, r["end"] + s),
        )

    return let(unit_ranges(sub, P.JAVA_SENTENCE_END), chunks)


def chunk_ranges(text: Column, size: int = 1600, overlap: int = 200) -> Column:
    """array<range>: paragraph-aware chunks of ``text`` (C4), in order."""

    def by_paragraph(t, units):
        tail = F.element_at(units, -1)

        # the tail's text is cut once, bound, and descended into only if it is oversize
        def body(tail_text):
            descends = ~tail_text.rlike(P.JAVA_PARAGRAPH)

            def oversize(u):
                return F.when(
                    (u["start"] == tail["start"]) & descends, _sentence_level(tail_text, u["start"], size, overlap)
                ).otherwise(hard_windows(u["start"], u["end"], size, overlap))

            return pack(units, size, oversize)

        return F.when(F.size(units) == 1, hard_windows(F.lit(0), F.length(t), size, overlap)).otherwise(
            with_cut(t, lambda whole, part: let(part(tail["start"], tail["end"] - tail["start"]), body))
        )

    def chunks(t):
        n = F.length(t)
        return (
            F.when(n == 0, empty(RANGE_ARRAY))
            .when(n <= size, F.array(_rng(F.lit(0), n)))
            .when(t.rlike(P.JAVA_PARAGRAPH), let(unit_ranges(t, P.JAVA_PARAGRAPH), lambda u: by_paragraph(t, u)))
            .otherwise(_sentence_level(t, F.lit(0), size, overlap))
        )

    return let(text, chunks)


def sentence_ranges(text: Column) -> Column:
    return unit_ranges(text, P.JAVA_SENTENCE_END)


def paragraph_ranges(text: Column) -> Column:
    return unit_ranges(text, P.JAVA_PARAGRAPH)
