"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Slot t of the schedule belongs to the source in whose share of the cumulative weights the
point frac(t * golden ratio) falls, so every stretch of slots is near the target mix.
Each source's rows are shuffled by a hash, laid end to end and cut into blocks of equal
size; the source's r-th slot takes its r-th block, starting over after the last one.
A source takes blocks until its target; the last one is cut there.  Nothing is taken but by
a slot: shares are in proportion to the blocks that the targets need, M in all, and 2 M + 16
slots are dealt.  Of as many golden-ratio points neighbours are less than 1 / M apart, so each
source gets all the slots it needs.

Prefix sums are two-level (hash buckets of about ``BUCKET`` rows, then rows in a bucket), so
a source with a third of all rows is spread over many tasks.

Null sources are one source, last in order; null or wordless texts have size 0 and are taken
0 times; repeated rows are shuffled as separate rows; empty tables give empty results.  ``mix``
reads the three columns named and returns its own, ``mixed_rows`` those of the input; other
columns play no part, whatever their names.  One row per source is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.llm.blocks import WORD_PATTERN, settle

GOLDEN = 0.6180339887498949
BUCKET = 1_000
SLOTS = 1 << 16
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Words of whole texts (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt out by weight, no target over
    ``most`` times its source's size.  Dealing the excess out again until nothing exceeds its
    limit gives each source min(limit, level * weight) for one common level: sources are
    capped in the order of limit / weight, and the level follows from the rest."""
    # one row per source from here on
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("limit", most * F.col("source_size"))
    t = t.withColumn("ratio", F.col("limit") / F.col("w"))
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = t.withColumn("nth", F.row_number().over(every))
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("open_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    t = t.withColumn("rest", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
    # the first source in this order whose limit is not reached fixes the level
    level = F.min(F.when(F.col("limit") * F.col("open_w") >= F.col("rest") * F.col("w"), F.struct("nth", (F.col("rest") / F.col("open_w")).alias("level")))).over(whole)
    t = t.withColumn("level", level["level"])
    target = F.least(F.col("limit"), F.col("level") * F.col("w"))
    return t.select("source", "source_size", F.coalesce(target, F.col("limit")).cast("double").alias("target"), "w")


def schedule(goal: DataFrame, slots: int | Column = SLOTS) -> DataFrame:
    """(source, rank, slot): the slots of each source in the order of the schedule; ``slots`` is
    their number."""
    spark = goal.sparkSession
    whole = Window.partitionBy()
    to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    share = goal.select("source", (F.sum("target").over(to) / F.sum("target").over(whole)).alias("high"), ((F.sum("target").over(to) - F.col("target")) / F.sum("target").over(whole)).alias("low")).where("high > low")
    # points meet shares in cells, as many as sources: a share lies in few cells and a cell
    # meets few shares, however many sources there are
    cells = share.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    share = share.withColumn("cells", cells)
    last_cell = F.least(F.floor(F.col("high") * F.col("cells")), F.col("cells") - 1)
    share = share.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * F.col("cells")), last_cell)).alias("cell"))
    t = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    wide = F.lit(1 << 10).cast("long")
    first = spark.range(1 << 10).withColumn("slots", F.lit(slots).cast("long")).where("id < slots")
    points = first.select(F.explode(F.sequence(F.col("id"), F.col("slots") - 1, wide)).alias("slot")).withColumn("x", t - F.floor(t))
    points = points.withColumn("cells", cells).withColumn("cell", F.floor(F.col("x") * F.col("cells")))
    dealt = points.join(share, "cell").where("x >= low and x < high").select("slot", "source")
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1)


def mix(df: DataFrame, column: str = "text", id_column: str = "doc_id", source_column: str = "source", slots: int = SLOTS) -> DataFrame:
    """Per row: id, size, source, source_size, target, start (place in its source's shuffled
    stream), taken, first_slot and second_slot (place in the schedule of its first block taken,
    and of the first when its source starts over; null: not taken)."""
    size = word_count(F.col(column))
    rows = df.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), F.col(column).alias("text"))
    # the shuffle: md5 of id and size; equal keys are ordered by id, size
    rows = rows.select("id", "source", "size", F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"))).alias("key"))
    # the word counts are read by every step that follows
    return _mix(settle(rows), slots).select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "start", "taken", "first_slot", "second_slot")


def _mix(rows: DataFrame, slots: int) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sizes.select("source", "source_size")).drop("w")
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)))
    keyed = _same(rows, sizes.select("source", "n"), "source").withColumn("bucket", F.floor(part * F.ceil(F.col("n") / BUCKET))).drop("n")
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    before = buckets.select("source", "bucket", (F.sum("b_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("b_size")).alias("b_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = _same(keyed.withColumn("nth", F.row_number().over(inside)).withColumn("run", run), before, "source", "bucket")
    placed = _same(placed.withColumn("start", F.col("b_before") + F.col("run") - F.col("size")), goal, "source")
    # so large that about ``slots`` blocks reach the targets; from whole numbers, so exact
    block = goal.agg(F.greatest(F.ceil(1.5 * F.sum("source_size") / slots), F.lit(1)).cast("long")).scalar()
    goal_b = goal.withColumn("block", block)
    # slots by rank: the r-th takes block r mod blocks, cut where the target is reached
    n_blocks = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    ranks = goal_b.where("target > 0").withColumn("blocks", n_blocks)
    last = F.floor(F.col("target") / F.col("source_size")) * F.col("blocks") + F.col("blocks")
    ranks = ranks.withColumn("rank", F.explode(F.sequence(F.lit(0), F.least(last, 2 * F.col("blocks")).cast("long") - 1)))
    ranks = ranks.withColumn("b", F.col("rank") % F.col("blocks"))
    length = F.least(F.col("block"), F.col("source_size") - F.col("b") * F.col("block"))
    from_ = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("b") * F.col("block")
    words = F.greatest(F.least(F.round("target").cast("long") - from_, length), F.lit(0)).cast("long")
    due = ranks.select("source", "rank", "b", F.floor(F.col("rank") / F.col("blocks")).alias("turn"), words.alias("words")).where("words > 0")
    needed = due.groupBy("source").agg(F.count(F.lit(1)).alias("target"))
    slots_dealt = needed.agg(2 * F.sum("target") + 16).scalar()
    # a block is taken by the slot of its rank only
    taken = _same(due, schedule(needed, slots_dealt), "source", "rank")
    by_block = taken.groupBy("source", "b").agg(F.collect_list(F.struct("turn", "words", "slot")).alias("cuts"))
    placed = placed.withColumn("block", block)
    end = F.col("start") + F.col("size")
    some = placed.withColumn("b", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))).otherwise(F.array(F.floor(F.col("start") / F.col("block"))))))
    met = _same(some, by_block, "source", "b", how="left")
    lo = F.greatest(F.col("start") - F.col("b") * F.col("block"), F.lit(0))
    hi = F.least(end - F.col("b") * F.col("block"), F.col("block"))
    words_of = lambda cut: F.greatest(F.least(cut["words"], hi) - lo, F.lit(0)).cast("long")
    part_taken = F.coalesce(F.aggregate("cuts", F.lit(0).cast("long"), lambda a, cut: a + words_of(cut)), F.lit(0).cast("long"))
    slot_of = lambda turn: F.array_min(F.transform(F.filter("cuts", lambda cut: (cut["turn"] == turn) & (words_of(cut) > 0)), lambda cut: cut["slot"]))
    met = met.withColumn("part", part_taken).withColumn("slot_0", slot_of(0)).withColumn("slot_1", slot_of(1))
    one = ["source", "start", "id", "size", "key", "source_size", "target", "nth", "bucket"]
    return met.groupBy(*one).agg(F.sum("part").alias("taken"), F.min("slot_0").alias("first_slot"), F.min("slot_1").alias("second_slot"))


def _same(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Join on columns of equal names; nulls are equal."""
    named = right.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns))
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(named[f"_{c}"])
    return left.join(named, cond, how).drop(*(f"_{c}" for c in on))


def mixed_rows(df: DataFrame, column: str = "text", id_column: str = "doc_id", source_column: str = "source", slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, in any order (``mix`` gives the slots);
    where it takes part of a row's words, the text holds the first of them, joined by one
    space."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    key = F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), h.cast("string"))
    rows = df.select(F.struct("*").alias("row"), key.alias("key"), F.col(column).alias("text"), F.col(source_column).alias("source"))
    # equal rows have equal keys; they are told apart by a number
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    dealt = mix(rows, "text", "key", "source", slots).where("taken > 0").select("key", "size", "taken", "start")
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("taken"), "start")))
    met = rows.drop("source", "text").withColumn("nth", nth).join(dealt, ["key", "nth"])
    cut = (F.col("taken") % F.col("size")).cast("int")
    met = met.select("*", F.explode(F.flatten(F.array(
        F.array_repeat(F.lit(-1), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>"))))).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{column}"), F.lit(WORD_PATTERN), F.lit(0)), 1, F.greatest("words", F.lit(1))), " ")
    text = F.when(F.col("words") > 0, first).otherwise(F.col(f"row.{column}"))
    return met.select(*(text.alias(c) if c == column else F.col(f"row.`{c}`").alias(c) for c in df.columns))
