"""Layer 1 on long texts, spread over many tasks.

No match of any detector holds a character outside ``PLAIN``: letters and digits that the
grammars name, white space and a few signs.  Other characters (``;``, ``:``, quotes, letters with
accents, ...) are points where every scan is free, whatever came before, and where no span
or chain of overlapping spans crosses.  So a text is cut after the first such character beyond
each ``size`` code points, each slice is scanned and resolved alone, and the slices' spans,
shifted, are exactly the text's.  A slice begins with the character that ends the one before
it, for word boundaries, and is followed by the lines in which the look-ahead for labelled forms
may read (V2), if it can hold an address at all.

Cutting reads the text once in its row; scanning, the costly part, runs by slice.  A stretch
without any such character is one slice, however long.  Null texts are "".  Rows of equal ids
are told apart by no one: ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.detectors import PinRegistry
from ..functions.spans import explode_rows, label_counts, let, mask, once, resolve, scan
from ..functions.spans import SPAN_ARRAY
from .regex_layer import with_candidates

SIZE = 1 << 18
#: Every character that a match can hold.
PLAIN = f"A-Za-z0-9{P.JAVA_DIGIT_BODY}{P.JAVA_SPACE_BODY},._%+@()/\\-"
#: Lines that the look-ahead reads: the one an address starts in and eight more.
_LINES = 9
_NEAR = 4096
# what a slice must hold for an address to start in it
_STARTS = r"(?:Flat|No|House|Door|Plot|Tower|Block|Sector|Survey)"


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}[{PLAIN}]*+(?:.|$)|.+"), F.lit(0))


def _ahead(text: Column, piece: Column, end: Column) -> Column:
    """The lines after a slice that a look-ahead from within may read."""

    def lines(near):
        return F.when(F.octet_length(F.substring_index(near, "\n", _LINES)) < F.octet_length(near), F.substring_index(near, "\n", _LINES)).otherwise(
            F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", _LINES))

    return F.when(piece.rlike(_STARTS), let(F.substring(text, end + 1, F.lit(_NEAR)), lines)).otherwise(F.lit(""))


def slices(df: DataFrame, id_col: str, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, slice, offset, length, before, text, ahead): the slices of each row's text; ``text``
    begins with the ``before`` characters (0 or 1) of the slice before it."""
    kind = "array<struct<offset:int,length:int,before:int,text:string,ahead:string>>"

    def cut(text):
        def step(acc, piece):
            n, before = F.length(piece), F.length(acc["last"])
            item = F.struct(acc["at"].alias("offset"), n.alias("length"), before.alias("before"), F.concat(acc["last"], piece).alias("text"), _ahead(text, piece, acc["at"] + n).alias("ahead"))
            return {"at": acc["at"] + n, "last": F.right(piece, F.lit(1))}, F.array(item).cast(kind)

        return scan(_pieces(text, size), {"at": F.lit(0), "last": F.lit("")}, _array(kind), step)

    staged = df.select(F.col(id_col), once(let(F.coalesce(F.col(text_col), F.lit("")), cut)).alias("_slices"))
    return staged.select(id_col, F.posexplode("_slices").alias("slice", "s")).select(id_col, "slice", "s.*")


def _array(kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind)


def _scanned(df: DataFrame, id_col: str, text_col: str, registry: PinRegistry | None, size: int, tasks: int | None) -> DataFrame:
    """Slices with their candidates, dealt to tasks by id and slice."""
    parts = slices(df, id_col, text_col, size)
    parts = parts.repartition(tasks, id_col, "slice") if tasks else parts.repartition(id_col, "slice")
    parts = parts.withColumn("_all", F.concat("text", "ahead"))
    found = with_candidates(parts, "_all", registry, name="_cands")
    return found.withColumn("_cands", once(F.filter("_cands", lambda c: c["end"] <= F.col("before") + F.col("length")))).drop("_all", "ahead")


def long_candidates(df: DataFrame, id_col: str, text_col: str = "text", registry: PinRegistry | None = None, size: int = SIZE, tasks: int | None = None) -> DataFrame:
    """P1 over slices: (id, start, end, label, prio), offsets in the whole text."""
    found = _scanned(df, id_col, text_col, registry, size, tasks)
    at = F.col("offset") - F.col("before")
    return explode_rows(found, "_cands", "c", id_col, "offset", "before").select(
        id_col, *((F.col(f"c.{x}") + at).cast("bigint").alias(x) for x in ("start", "end")), "c.label", F.col("c.prio").cast("bigint").alias("prio"))


def redact_slices(df: DataFrame, id_col: str, text_col: str = "text", registry: PinRegistry | None = None, size: int = SIZE, tasks: int | None = None) -> DataFrame:
    """Layer 1 by slice: (id, slice, offset, spans, redacted, counts); the redacted slices of an id,
    in order, are its redacted text."""
    found = _scanned(df, id_col, text_col, registry, size, tasks)
    kept = found.withColumn("_kept", once(resolve(F.col("_cands"))))
    at = F.col("offset") - F.col("before")
    spans = F.transform("_kept", lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["label"].alias("label"))).cast(SPAN_ARRAY)
    # spans do not hold the character before the slice, so it leads the masked text
    text = F.substring(mask(F.col("text"), F.col("_kept")), F.col("before") + 1, F.lit(2**31 - 1))
    return kept.select(id_col, "slice", "offset", spans.alias("spans"), text.alias("redacted"), label_counts(F.col("_kept")["label"]).alias("counts"))


def redact_long(df: DataFrame, id_col: str, text_col: str = "text", registry: PinRegistry | None = None, size: int = SIZE, tasks: int | None = None) -> DataFrame:
    """(id, redacted, regex_hits) of every row, its slices put together again."""
    done = redact_slices(df, id_col, text_col, registry, size, tasks)
    whole = done.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("slice", "redacted"))).alias("_parts"), F.sum(F.size("spans")).cast("bigint").alias("regex_hits"))
    whole = whole.select(id_col, F.array_join(F.col("_parts")["redacted"], "").alias("redacted"), "regex_hits")
    # texts without a character have no slice
    return df.select(id_col).join(whole, id_col, "left").select(id_col, F.coalesce("redacted", F.lit("")).alias("redacted"), F.coalesce("regex_hits", F.lit(0)).alias("regex_hits"))
