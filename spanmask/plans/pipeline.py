"""Whole-pipeline transform (V7, Q1-Q3): deterministic layer, then entities.

``redact(df)`` returns the input rows plus the result columns of Q3, the same in every
mode: ``redacted``, ``regex_counts``, ``model_counts``, ``mode``, ``num_chunks``,
``scored_chunks``, ``model_errors``, ``model_skipped`` (spans that merging kept and masking passed
over, whose text stays readable in part) and the totals ``regex_hits``/``model_hits``.  With
the model disabled the entity branch is never planned.  Intermediate columns have
reserved names; an input column named like a result is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RedactConfig
from ..functions.detectors import PinRegistry
from ..operators import regex_layer as RL
from ..operators.aggregates import map_total

COUNTS = T.MapType(T.StringType(), T.IntegerType())
RESULT = ["redacted", "regex_counts", "model_counts", "mode", "num_chunks", "scored_chunks", "model_errors", "model_skipped", "regex_hits", "model_hits"]
PREFIX = "__spanmask_"


def result(df: DataFrame, columns: list[str], text_col: str, mode: str, masked: Column, model_counts: Column,
           num_chunks: Column, scored_chunks: Column, errors: Column, skipped: Column | None = None) -> DataFrame:
    """The input's columns and RESULT; blank rows keep their text and count nothing (V7)."""
    blank = RL.is_blank(F.col(text_col))
    none = F.create_map().cast(COUNTS)
    out = df.select(
        *(F.col(f"`{c}`") for c in columns),
        F.when(blank, F.coalesce(F.col(text_col), F.lit(""))).otherwise(masked).alias("redacted"),
        F.when(blank, none).otherwise(F.col(PREFIX + "counts")).alias("regex_counts"),
        F.when(blank, none).otherwise(model_counts.cast(COUNTS)).alias("model_counts"),
        F.when(blank, F.lit("blank")).otherwise(F.lit(mode)).alias("mode"),
        F.when(blank, F.lit(0)).otherwise(num_chunks).alias("num_chunks"),
        F.when(blank, F.lit(0)).otherwise(scored_chunks).alias("scored_chunks"),
        F.when(blank, F.array().cast("array<string>")).otherwise(errors).alias("model_errors"),
        (F.lit(0) if skipped is None else F.when(blank, F.lit(0)).otherwise(skipped)).alias("model_skipped"),
    )
    return out.withColumn("regex_hits", map_total(F.col("regex_counts"))).withColumn("model_hits", map_total(F.col("model_counts")))


def redact(df: DataFrame, text_col: str = "text", registry: PinRegistry | None = None,
           disable_model: bool | None = None, config: RedactConfig | None = None, scorer=None) -> DataFrame:
    config = config or RedactConfig()
    RL.check_free(df, RESULT)
    if disable_model is None:
        disable_model = config.disable_model
    out = RL.redact_regex(df, text_col, registry, PREFIX)
    if disable_model:
        return result(out, df.columns, text_col, "disabled", F.col(PREFIX + "text"), F.create_map().cast(COUNTS),
                      F.lit(0), F.lit(0), F.array().cast("array<string>"))
    from .pipeline_full import entity_layer

    return entity_layer(out, df.columns, text_col, config, scorer)
