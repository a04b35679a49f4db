"""Per-document and run-level aggregates (A1-A4, P5 long form).

Per-document figures are in-row projections (no shuffle); run-level summaries
are hash aggregates whose partial step runs map-side, so only one small row per
(task, group) crosses the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import label_counts


def map_total(m) -> "F.Column":
    return F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)


def label_counts_long(df: DataFrame, id_col: str, counts_col: str) -> DataFrame:
    """(id, label, n) from a label -> count map (P5)."""
    out = df.select(id_col, F.explode_outer(counts_col).alias("label", "n"))
    return out.where(F.col("label").isNotNull()).select(id_col, "label", F.col("n").cast("bigint").alias("n"))


def doc_hits(df: DataFrame, id_col: str, counts_col: str = "rx_counts") -> DataFrame:
    """Hits per document, zero included (A1)."""
    return df.select(id_col, map_total(F.col(counts_col)).cast("bigint").alias("regex_hits"))


def audit(df: DataFrame, id_col: str, text_col: str, out_col: str = "rx_text",
          counts_col: str = "rx_counts") -> DataFrame:
    """Audit record per document: lengths and counts, never the text (A3)."""
    hits = map_total(F.col(counts_col))
    return df.select(
        id_col,
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("input_len"),
        hits.cast("bigint").alias("regex_hits"),
        F.size(F.map_keys(F.col(counts_col))).cast("bigint").alias("regex_labels"),
        F.length(out_col).cast("bigint").alias("output_len"),
        (hits > 0).alias("changed"),
    )


def full_audit(df: DataFrame, id_col: str, text_col: str, run_id: str = "") -> DataFrame:
    """Audit record of both layers per document of ``redact`` (A3): lengths, hits and labels
    of each layer, chunks, chunks scored and failed, failures by type, spans that masking passed
    over, and the run id; never the text."""
    return df.select(
        id_col,
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("input_len"),
        F.length("redacted").cast("bigint").alias("output_len"),
        *(F.col(f"{layer}_hits").cast("bigint").alias(f"{layer}_hits") for layer in ("regex", "model")),
        *(F.size(F.map_keys(F.col(f"{layer}_counts"))).cast("bigint").alias(f"{layer}_labels") for layer in ("regex", "model")),
        F.col("num_chunks").cast("bigint").alias("num_chunks"),
        F.col("scored_chunks").cast("bigint").alias("scored_chunks"),
        F.size("model_errors").cast("bigint").alias("failed_chunks"),
        label_counts(F.col("model_errors")).alias("error_types"),
        F.col("model_skipped").cast("bigint").alias("skipped_spans"),
        (F.col("regex_hits") + F.col("model_hits") > 0).alias("changed"),
        "mode",
        F.lit(run_id).alias("run_id"),
    )


def error_summary(df: DataFrame) -> DataFrame:
    """(error, n): failed chunks of a run by the type of their error."""
    return df.select(F.explode("model_errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def run_summary(df: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Run total per (layer, label) over all documents (A2).

    ``layers`` maps a layer name to its counts column; labels of the two layers
    differ in case (``EMAIL`` vs ``person``) so they never collide.  One pass:
    both maps are flattened into one array per row, then a hash aggregate with
    a map-side partial step.
    """
    def tagged(layer):
        # one-argument lambda: PySpark reads a two-argument one as (element, index)
        return lambda e: F.struct(F.lit(layer).alias("layer"), e["key"].alias("label"), e["value"].alias("n"))

    entries = [F.transform(F.map_entries(F.col(col)), tagged(layer)) for layer, col in layers.items()]
    flat = df.select(F.explode_outer(F.concat(*entries)).alias("e")).where(F.col("e").isNotNull())
    return flat.groupBy(F.col("e.layer").alias("layer"), F.col("e.label").alias("label")).agg(
        F.sum("e.n").cast("bigint").alias("n"))


def chunk_stats(chunks: DataFrame, id_col: str) -> DataFrame:
    """Chunks per document with their largest size (A4)."""
    return chunks.groupBy(id_col).agg(
        F.count("*").cast("bigint").alias("num_chunks"),
        F.max(F.col("end") - F.col("start")).cast("bigint").alias("max_chunk_len"),
        F.sum(F.col("end") - F.col("start")).cast("bigint").alias("total_len"),
    )


def run_metrics() -> list["F.Column"]:
    """Aggregates over the result of ``redact`` that tell a run; never text."""
    hits = F.col("regex_hits") + F.col("model_hits")
    total = {
        "regex_hits": F.col("regex_hits"), "model_hits": F.col("model_hits"), "chunks": F.col("num_chunks"), "scored_chunks": F.col("scored_chunks"),
        "failed_chunks": F.size("model_errors"), "skipped_spans": F.col("model_skipped"), "output_chars": F.length("redacted"), "changed_docs": F.when(hits > 0, 1).otherwise(0)}
    return [F.count(F.lit(1)).alias("docs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in total.items())]


def observe_run(df: DataFrame, run_id: str):
    """Whole-run metrics gathered while the result is written (A3, Q5).

    Returns (DataFrame, Observation); after the write action,
    ``observation.get`` holds document count, hits per layer and lengths;
    never text.  No extra pass over the data.
    """
    from pyspark.sql import Observation

    obs = Observation(f"spanmask_{run_id}")
    return df.observe(obs, *run_metrics()), obs
