"""Span operators as table operators (P2, P4, P6, P7, P8): one row per span.

For spans that do not fit in a row: all sweep over a document's positions with a running
maximum, sum or next value.  A sweep is two-level: positions fall into buckets of ``BUCKET``, a
window runs inside each bucket, and a second one over the buckets' totals, so a document with
a third of all spans is spread over many tasks and each sorts one bucket at a time.  What a
sweep reads is checkpointed, so jobs run when these operators are called.

Offsets are half-open; spans hold one character or more.  Other columns pass through where a
result has the rows of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

BUCKET = 1 << 16
_B, _T, _OWN = "__spanmask_bucket", "__spanmask_total", "__spanmask_own"


def running(df: DataFrame, id_cols: Sequence[str], at: str, order: Sequence[Column], value: Column, fold: Callable[[Column], Column], name: str,
            own: bool = False, down: bool = False) -> DataFrame:
    """``df`` with ``name``: the fold (F.max, F.min, F.sum) of ``value`` over the rows of the same
    ids before each, its own row included if ``own``, in the order of position ``at`` (falling
    if ``down``), then ``order``; null where there are none.

    ``df`` is read twice, for the rows and for the buckets' totals, so it is settled first."""
    bucket = F.floor(F.col(at) / BUCKET)
    way = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    df = settled(df.withColumn(_B, bucket).withColumn(_T, value))
    inside = Window.partitionBy(*id_cols, _B).orderBy(way(at), *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    totals = df.groupBy(*id_cols, _B).agg(fold(F.col(_T)).alias(_T))
    before = Window.partitionBy(*id_cols).orderBy(way(_B)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*id_cols, _B, fold(F.col(_T)).over(before).alias(_T))
    near = df.withColumn(_OWN, fold(F.col(_T)).over(inside)).drop(_T).join(totals, [*id_cols, _B])
    pair = F.array(F.col(_OWN), F.col(_T))
    known = F.filter(pair, lambda x: x.isNotNull())
    both = F.when(F.size(known) > 0, {"max": F.array_max, "min": F.array_min}.get(fold.__name__, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))(known))
    return near.withColumn(name, both).drop(_B, _T, _OWN)


def merge_table(spans: DataFrame, id_col: str, ties: Sequence[str]) -> DataFrame:
    """Drop a span inside the last kept one.  Kept ends only grow, so the last kept end is
    the running maximum of earlier ends."""
    order = (F.col("start") - F.col("end"), *map(F.col, ties))
    m = F.col("__spanmask_reach")
    out = running(spans, [id_col], "start", order, F.col("end"), F.max, "__spanmask_reach")
    inside = m.isNotNull() & (F.col("start") < m) & (F.col("end") <= m)
    return out.where(~inside).drop("__spanmask_reach").select(*spans.columns)


def guard_table(spans: DataFrame, covered: DataFrame, id_col: str) -> DataFrame:
    """Drop spans that touch a covered range (id, start, end).

    Spans and ranges are one stream of events: a span stands at its end, a range at its start,
    after the spans that end there.  A span touches a range if the furthest end of the ranges
    before it lies beyond its start."""
    row = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    events = spans.select(F.col(id_col).alias("id"), F.col("end").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("reach"), row.alias("row"))
    ranges = covered.select(F.col(id_col).alias("id"), F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("reach"), F.lit(None).cast(events.schema["row"].dataType).alias("row"))
    met = running(events.unionByName(ranges), ["id"], "at", [F.asc("kind")], F.col("reach"), F.max, "far")
    return met.where((F.col("kind") == 0) & (F.col("far").isNull() | (F.col("far") <= F.col("row.start")))).select("row.*")


def uncovered_table(covered: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """(id, start, end) of the gaps between the covered ranges (id, start, end) of texts
    (id, length); ranges may be nested or in any order."""
    ranges = covered.select(F.col(id_col), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    tails = texts.select(F.col(id_col), F.col("length").cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    met = running(ranges.unionByName(tails), [id_col], "start", [F.asc_nulls_last("end")], F.col("end"), F.max, "before")
    gap = met.select(id_col, F.coalesce("before", F.lit(0)).alias("from"), F.col("start").alias("to")).where("to > from")
    return gap.select(id_col, F.col("from").alias("start"), F.col("to").alias("end"))


def covered_table(kept: DataFrame, id_col: str, placeholder: Column | None = None) -> DataFrame:
    """``kept`` (resolved spans) with out_start and out_end, the place of each one's
    placeholder (of ``placeholder`` characters; else ``[label]``) in the masked text."""
    size = F.length("label") + 2 if placeholder is None else placeholder
    grows = (size - (F.col("end") - F.col("start"))).cast("long")
    out = running(kept, [id_col], "start", [], grows, F.sum, "__spanmask_shift")
    at = (F.col("start") + F.coalesce("__spanmask_shift", F.lit(0))).cast("long")
    return out.withColumn("out_start", at).withColumn("out_end", at + size).drop("__spanmask_shift")


def resolve_table(spans: DataFrame, id_col: str, priority: str = "prio") -> DataFrame:
    """The spans that leftmost-longest resolution keeps; equal spans go to the lowest
    ``priority``.  Spans with equal priority too must be equal in all columns.

    Of the spans that start at one place only the best can be kept.  It is kept if the chain of
    kept spans, each followed by the first one that starts at or after its end, comes by.
    Spans that no earlier one reaches are always in the chain and start an island; inside the
    islands of more than one span the chain is followed by pointer doubling, so the rounds
    are the logarithm of the longest chain of spans that overlap."""
    names = spans.columns
    best = F.min(F.struct((F.col("start") - F.col("end")).alias("size"), F.col(priority), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))).alias("best")
    nodes = spans.groupBy(F.col(id_col).alias("id"), F.col("start").cast("long").alias("at")).agg(best)
    nodes = nodes.select("id", "at", F.col("best.row").alias("row"), F.col("best.row.end").cast("long").alias("end"))
    nodes = running(nodes, ["id"], "at", [], F.col("end"), F.max, "reach")
    nodes = settled(nodes.select("id", "at", "end", "row", (F.col("reach").isNull() | (F.col("reach") <= F.col("at"))).alias("head")))
    # where each node's chain goes on inside its island; a node stands after the ends at its place
    ends = nodes.select("id", F.col("end").alias("at"), F.lit(1).alias("kind"), F.col("at").alias("of"), F.lit(None).cast("boolean").alias("head"))
    starts = nodes.select("id", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of"), "head")
    following = F.when(F.col("kind") == 0, F.struct("at", "head"))
    met = running(starts.unionByName(ends), ["id"], "at", [F.asc("kind")], following, F.min, "next", down=True)
    jumps = met.where("kind = 1 and next is not null and not next.head").select("id", F.col("of").alias("at"), F.col("next.at").alias("to"))
    jumps = settled(jumps)
    reached = nodes.where("head").select("id", "at")
    while not jumps.isEmpty():
        far = jumps.select("id", F.col("at").alias("to"), F.col("to").alias("far"))
        reached = settled(reached.unionByName(reached.join(jumps, ["id", "at"]).select("id", F.col("to").alias("at"))))
        jumps = settled(jumps.join(far, ["id", "to"]).select("id", "at", F.col("far").alias("to")))
    return nodes.join(reached, ["id", "at"], "left_semi").select("row.*")
