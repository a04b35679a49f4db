"""Entity branch of the pipeline (Q2): segments -> chunks -> score -> mask.

A scorer that works in the row (a dictionary of checked size) chunks the uncovered segments
(P6, C5) and scores them there, and the whole plan is a map.  For other scorers the chunks
become rows of their own, equal ones of equal documents once, spread over all tasks and scored
(E1); their hits are gathered by document and joined back to it.  Kept hits (V4-V6), remapped (P10), are merged (P7), guarded (P8) and masked (P9) by Column
expressions.

With chunk rows, layer 1 feeds both them and the join, so its rows are persisted on disk when
the query first runs (DISK_ONLY; lost parts are computed again).  The result's ``staged``
attribute is that frame (None: nothing is persisted); ``release`` frees it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RedactConfig
from ..functions import patterns as P
from ..functions.chunks import chunk_ranges
from ..functions.spans import label_counts, mask, once, with_cut
from ..operators import entities as E
from ..operators.regex_layer import is_blank
from ..operators.segments import segments_of
from .pipeline import PREFIX, result

CHUNKS, KEY = PREFIX + "chunks", PREFIX + "key"


def chunk_column(text, covered, size: int, overlap: int):
    """array<struct<start,end>>: chunks of every uncovered segment, in text offsets."""
    per_seg = F.transform(
        segments_of(text, covered),
        lambda g: F.transform(
            chunk_ranges(g["seg_text"], size, overlap),
            lambda r: F.struct((g["seg_start"] + r["start"]).alias("start"), (g["seg_start"] + r["end"]).alias("end")),
        ),
    )
    return F.flatten(per_seg)


def with_chunks(df: DataFrame, config: RedactConfig, text_col: str = PREFIX + "text", covered_col: str = PREFIX + "covered") -> DataFrame:
    """Adds the chunk ranges, and a key that rows of equal text and equal ranges share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 16 bytes of a SHA-256: short, and no one can make two texts share them
    key = F.substring(F.unhex(F.sha2(F.concat_ws("|", F.to_json(F.col(covered_col)), text), 256)), 1, 16)
    return df.withColumn(CHUNKS, once(chunk_column(text, F.col(covered_col), config.chunk_size, config.overlap))).withColumn(KEY, key)


def chunk_rows(staged: DataFrame, text_col: str = PREFIX + "text") -> DataFrame:
    """(key, chunk_idx, cstart, text) of all chunks that are not blank, each once, spread
    over the tasks by a hash: a long document's chunks go to many of them."""
    texts = with_cut(F.col(text_col), lambda t, part: F.transform(
        F.col(CHUNKS), lambda c: F.struct(c["start"].alias("cstart"), part(c["start"], c["end"] - c["start"]).alias("text"))))
    rows = staged.select(F.col(KEY).alias("key"), F.posexplode_outer(texts).alias("chunk_idx", "c"))
    rows = rows.select("key", "chunk_idx", "c.cstart", "c.text").where(~is_blank(F.col("text")))
    return rows.groupBy("key", "chunk_idx").agg(F.first("cstart").alias("cstart"), F.first("text").alias("text"))


def scored_rows(staged: DataFrame, scorer, threshold: float, labels=P.ENTITY_LABELS, text_col: str = PREFIX + "text") -> DataFrame:
    """Rows of ``entities.SCORED_FIELDS`` for the chunks of ``staged``."""
    if scorer is None:
        raise ValueError("the entity layer needs a scorer (or disable_model=True)")
    return scorer.scored(chunk_rows(staged, text_col), labels, threshold)


def row_scorer(scorer, config: RedactConfig, labels=P.ENTITY_LABELS):
    """The scorer's function for documents in their rows; None if it needs chunk rows."""
    offered = getattr(scorer, "in_row", None)
    return offered(labels, config.threshold, config.chunk_size, config.overlap) if offered else None


def release(df: DataFrame) -> None:
    """Free what the entity layer persisted for ``df``, a result of ``redact``."""
    staged = getattr(df, "staged", None)
    if staged is not None:
        staged.unpersist()


def entity_layer(layer1: DataFrame, columns: list[str], text_col: str, config: RedactConfig, scorer) -> DataFrame:
    if scorer is None:
        raise ValueError("the entity layer needs a scorer (or disable_model=True)")
    scored, hits, errors = (F.col(PREFIX + c) for c in ("scored_chunks", "hits", "model_errors"))
    in_row, keep = row_scorer(scorer, config), None
    if in_row:
        row = F.col(PREFIX + "row")
        out = layer1.withColumn(PREFIX + "row", in_row(F.col(PREFIX + "text"), F.col(PREFIX + "covered")))
        out = out.withColumn(PREFIX + "hits", once(E.kept_in_row(row["hits"], config.threshold)))
        num_chunks, scored, errors = row["chunks"], row["scored"], F.array().cast("array<string>")
    else:
        staged = keep = with_chunks(layer1, config).persist(StorageLevel.DISK_ONLY)
        found = E.gather(scored_rows(staged, scorer, config.threshold), config.threshold).withColumnRenamed("key", KEY)
        for name in ("scored_chunks", "model_errors", "hits"):
            found = found.withColumnRenamed(name, PREFIX + name)
        out = staged.join(found, KEY, "left")
        hits, scored, errors = F.coalesce(hits, F.array().cast(E.ESPAN_ARRAY)), F.coalesce(scored, F.lit(0)), F.coalesce(errors, F.array().cast("array<string>"))
        num_chunks = F.size(CHUNKS)
    spans, kept = F.col(PREFIX + "entities"), PREFIX + "entities"
    guarded = PREFIX + "guarded"
    out = out.withColumn(guarded, once(E.guard(E.merge_contained(hits), F.col(PREFIX + "covered"))))
    out = out.withColumn(kept, once(E.greedy(F.col(guarded))))
    out = result(
        out, columns, text_col, getattr(scorer, "name", "scorer"), mask(F.col(PREFIX + "text"), spans, E.upper_placeholder),
        label_counts(spans["label"]), num_chunks, scored, errors, F.size(guarded) - F.size(kept))
    out.staged = keep
    return out
