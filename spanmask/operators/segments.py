"""Gaps between covered ranges (P6), as an in-row fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import empty, scan, with_cut

SEG_TYPE = T.StructType([T.StructField("seg_start", T.IntegerType()), T.StructField("seg_text", T.StringType())])
SEG_ARRAY = T.ArrayType(SEG_TYPE)


def segments_of(text: Column, covered: Column) -> Column:
    """array<struct<seg_start,seg_text>>: text outside ``covered``.

    Tolerates unsorted and nested ranges: ranges are sorted and the cursor only
    moves forward (to the largest end seen so far).
    """

    def build(t, part):
        def gap(start, end):
            seg = F.struct(start.alias("seg_start"), part(start, end - start).alias("seg_text"))
            return F.when(end > start, F.array(seg)).otherwise(empty(SEG_ARRAY))

        return scan(
            F.array_sort(covered), {"cur": F.lit(0)}, SEG_ARRAY,
            lambda acc, c: ({"cur": F.greatest(acc["cur"], c["end"])}, gap(acc["cur"], c["start"])),
            lambda acc: gap(acc["cur"], F.length(t)),
        )

    # a text without ranges is one segment and not cut into blocks
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("seg_start"), text.alias("seg_text")))).otherwise(empty(SEG_ARRAY))
    return F.when(F.size(covered) == 0, whole).otherwise(with_cut(text, build))


def uncovered_segments(df: DataFrame, text_col: str, covered_col: str, name: str = "segments") -> DataFrame:
    return df.withColumn(name, segments_of(F.coalesce(F.col(text_col), F.lit("")), F.col(covered_col)))
