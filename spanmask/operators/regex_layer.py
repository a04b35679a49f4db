"""Layer 1: deterministic redaction of a text column.

Map-only: every document is handled inside its own row, so the plan is
scan -> project -> (write) with no exchange.  The projections are kept as
separate ``select`` steps so that Catalyst keeps each expensive array (regex
candidates, resolved spans) computed once instead of inlining it into every use.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.detectors import PIN_BITS, PinRegistry, all_cands, detector_cands
from ..functions.spans import covered_ranges, label_counts, mask, once, resolve


def is_blank(text: Column) -> Column:
    """Null, empty or only (Python-Unicode) whitespace (V7)."""
    return text.isNull() | ~text.rlike(f"[^{P.JAVA_SPACE_BODY}]")


def check_free(df: DataFrame, names: Iterable[str]) -> None:
    """Raise if ``df`` already has one of the columns that an operator adds."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input already has columns named {sorted(taken)}; rename them first")


def with_candidates(df: DataFrame, text_col: str = "text", registry: PinRegistry | None = None,
                    labels: Iterable[str] = P.DETECTOR_ORDER, name: str = "rx_cands") -> DataFrame:
    """Adds ``name``: array of candidate spans of the chosen detectors."""
    check_free(df, [name, PIN_BITS])
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = (registry or PinRegistry()).attach(df)
    return df.withColumn(name, once(all_cands(text, labels))).drop(PIN_BITS)


def detector_spans(df: DataFrame, label: str, text_col: str = "text",
                   registry: PinRegistry | None = None, raw: bool = False) -> DataFrame:
    """Adds ``spans``: one detector's matches as array<struct<start,end,label>>.

    ``raw`` lists candidates before the registry test (V1)."""
    check_free(df, ["spans", PIN_BITS])
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = (registry or PinRegistry()).attach(df)
    cands = detector_cands(text, label, raw=raw)
    spans = F.transform(cands, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["label"].alias("label")))
    return df.withColumn("spans", once(spans)).drop(PIN_BITS)


def redact_regex(df: DataFrame, text_col: str = "text", registry: PinRegistry | None = None,
                 out_prefix: str = "rx_") -> DataFrame:
    """Deterministic layer over ``text_col``.

    Adds ``rx_spans`` (kept spans with input and output offsets), ``rx_text``
    (masked text; null input becomes ""), ``rx_counts`` (map label -> n) and
    ``rx_covered`` (placeholder ranges in ``rx_text``), under another prefix if
    ``out_prefix`` says so.  Input columns of these names are an error.  The spans
    are computed once whatever is filtered or selected afterwards.
    """
    spans, out, counts, covered = (out_prefix + s for s in ("spans", "text", "counts", "covered"))
    check_free(df, [spans, out, counts, covered])
    staged = with_candidates(df, text_col, registry, name="__spanmask_cands")
    staged = staged.withColumn(spans, once(resolve(F.col("__spanmask_cands")))).drop("__spanmask_cands")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        staged.withColumn(out, once(mask(text, F.col(spans))))
        .withColumn(counts, label_counts(F.col(spans)["label"]))
        .withColumn(covered, once(covered_ranges(F.col(spans))))
    )
