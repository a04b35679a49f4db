"""SQL surface: functions and table functions that a session registers.

``register(spark, registry)`` adds to the session

* ``redact_text(text)``: the masked text of layer 1,
* ``redact_spans(text)``: its spans, array<struct<start,end,label>>,
* ``redact_counts(text)``: spans per label, map<string,int>,
* ``chunk_text(table(t), size, overlap)``: a row per chunk of each row's ``text``: the table's
  other columns, then chunk_idx, start, end (C1-C5).

    select doc_id, redact_text(text) from documents
    select * from chunk_text(table(select doc_id, text from documents), 1600, 200)

They are Arrow functions over the same grammars as the Column expressions, which stay the way
for DataFrames.  The PIN registry (800,000 PINs at most) is read once when they are registered.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import rowwise as R
from .functions.detectors import PinRegistry

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
_COUNTS = pa.map_(pa.string(), pa.int32())


def pins(spark: SparkSession, registry: PinRegistry | None) -> R.Pins:
    """The registry's PINs as one bitmap; none registered: empty."""
    rows = registry.rows(spark) if registry else None
    found = [] if rows is None else rows.select(F.col("pin").cast("int").alias("pin")).toArrow().column("pin").to_pylist()
    return R.Pins(found)


@dataclass
class ChunkColumns(AnalyzeResult):
    """The table's columns that pass through."""

    names: list[str] = field(default_factory=list)


class ChunkText:
    """Table function over a table with a ``text`` column."""

    def __init__(self, columns: ChunkColumns | None = None):
        self.names = columns.names if columns else []

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> ChunkColumns:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("chunk_text needs a table with a column named text: chunk_text(table(t), size, overlap)")
        if not (size.isConstantExpression and overlap.isConstantExpression and size.value > 0 and 0 <= overlap.value < size.value):
            raise ValueError("chunk_text needs a constant size and an overlap smaller than it")
        kept = [f for f in table.dataType.fields if f.name not in ("text", "chunk_idx", "start", "end")]
        added = [T.StructField(n, T.LongType()) for n in ("chunk_idx", "start", "end")]
        return ChunkColumns(T.StructType([*kept, *added]), names=[f.name for f in kept])

    def eval(self, row, size: int, overlap: int):
        same = [row[n] for n in self.names]
        for i, (start, end) in enumerate(R.chunk_ranges(row["text"], size, overlap)):
            yield (*same, i, start, end)


def register(spark: SparkSession, registry: PinRegistry | None = None) -> None:
    """Adds the functions to the session."""
    known = pins(spark, registry)

    @F.arrow_udf("string")
    def redact_text(texts: pa.Array) -> pa.Array:
        return pa.array([R.masked(t, known) for t in texts.to_pylist()], pa.string())

    @F.arrow_udf("array<struct<start:int,end:int,label:string>>")
    def redact_spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "label"), s, strict=True)) for s in R.spans(t, known)] for t in texts.to_pylist()], _SPANS)

    @F.arrow_udf("map<string,int>")
    def redact_counts(texts: pa.Array) -> pa.Array:
        return pa.array([list(Counter(s[2] for s in R.spans(t, known)).items()) for t in texts.to_pylist()], _COUNTS)

    for f in (redact_text, redact_spans, redact_counts):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("chunk_text", F.udtf(ChunkText))
