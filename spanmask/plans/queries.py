"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the supplied tables (or tables Spark derives from them) in
full.  Outputs are long forms with BIGINT offsets/counts so that they compare
value-for-value with the DuckDB texts in :mod:`spanmask.plans.oracle`.
"""

from __future__ import annotations

import hashlib
import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.detectors import PinRegistry, pin_rows
from ..functions.spans import explode_rows, posexplode_rows
from ..functions import chunks as C
from ..config import DEFAULT_CHUNK_SIZE, DEFAULT_OVERLAP
from ..operators.aggregates import chunk_stats, run_summary
from ..operators import entities as E
from ..functions.spans import mask, once
from ..config import RedactConfig
from . import pipeline as PL
from . import pipeline_full as PF
from ..operators import long_texts as LT
from ..operators import regex_layer as RL
from ..operators import span_tables as ST
from ..operators.aggregates import audit, doc_hits, error_summary, full_audit, label_counts_long
from ..operators.segments import uncovered_segments
from . import derived as D
from .. import sql
from ..session import ensure_checkpoint_dir
from ..sources.io import changed, decode_text, nonblank_redacted, spread, spread_rows
from ..sources.writeback import write_back, written_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _note_rows(spark, sf_dir) -> DataFrame:
    return spark.sql(D.NOTES_SQL, customer=table(spark, sf_dir, "customer"))


def notes(spark, sf_dir) -> DataFrame:
    return spread_rows(_note_rows(spark, sf_dir))


def ssn_notes(spark, sf_dir) -> DataFrame:
    return spread_rows(spark.sql(D.SSN_NOTES_SQL, customer=table(spark, sf_dir, "customer")))


def form_notes(spark, sf_dir) -> DataFrame:
    return spread_rows(spark.sql(D.FORM_NOTES_SQL, customer=table(spark, sf_dir, "customer")))


def blank_conversations(spark, sf_dir) -> DataFrame:
    return spread(spark.sql(D.BLANK_CONV_SQL, conversations=table(spark, sf_dir, "conversations")))


def para_docs(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    grouped = docs.groupBy(F.floor(F.col("doc_id") / 3).alias("g")).agg(
        F.min("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("parts"),
    )
    return grouped.select(
        "doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text")
    )


def registry_table(spark, sf_dir) -> DataFrame:
    return spark.sql(D.REGISTRY_SQL, customer=table(spark, sf_dir, "customer"))


def registry(spark, sf_dir) -> PinRegistry:
    return PinRegistry.from_table(registry_table(spark, sf_dir))


def _bigint(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- S1 -------------------------------------------------------------------
def q_source_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    text = decode_text(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


# ---- D1-D11 ---------------------------------------------------------------
def q_detect(spark, sf_dir, label, source, id_col):
    df = source(spark, sf_dir)
    spans = RL.detector_spans(df, label, "text", registry(spark, sf_dir))
    return explode_rows(spans, "spans", "s", id_col, "text").select(
        id_col,
        F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"),
        F.col("s.label").alias("label"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("match"),
    )


# ---- V1 as a table operator: broadcast left-semi join on the registry ------
def q_pin_semi_join(spark, sf_dir):
    df = notes(spark, sf_dir)
    raw = RL.detector_spans(df, "POSTAL_CODE", "text", raw=True)
    cands = explode_rows(raw, "spans", "s", "note_id", "text").select(
        "note_id",
        F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("pin"),
    ).where(F.length("pin") == 6)
    # PIN-shaped and distinct, so 800,000 short rows at most
    return cands.join(F.broadcast(pin_rows(registry_table(spark, sf_dir))), "pin", "left_semi")


# ---- P1-P5 ----------------------------------------------------------------
def q_all_spans(spark, sf_dir):
    df = RL.with_candidates(documents(spark, sf_dir), "text", registry(spark, sf_dir), name="c")
    return explode_rows(df, "c", "s", "doc_id").select(
        "doc_id", *[F.col("s." + n).cast("bigint").alias(n) for n in ("start", "end")],
        F.col("s.label").alias("label"), F.col("s.prio").cast("bigint").alias("prio"),
    )


def _layer1_docs(spark, sf_dir, source=documents):
    return RL.redact_regex(source(spark, sf_dir), "text", registry(spark, sf_dir))


def q_resolved_spans(spark, sf_dir):
    df = _layer1_docs(spark, sf_dir)
    return explode_rows(df, "rx_spans", "s", "doc_id").select(
        "doc_id", *_bigint("s.start", "s.end"), F.col("s.label").alias("label")
    ).toDF("doc_id", "start", "end", "label")


def q_redact_regex(spark, sf_dir):
    return _layer1_docs(spark, sf_dir).select("doc_id", F.col("rx_text").alias("text"))


def q_covered_ranges(spark, sf_dir):
    df = _layer1_docs(spark, sf_dir)
    return explode_rows(df, "rx_spans", "s", "doc_id").select(
        "doc_id",
        F.col("s.out_start").cast("bigint").alias("out_start"),
        F.col("s.out_end").cast("bigint").alias("out_end"),
        F.col("s.label").alias("label"),
    )


def q_label_counts(spark, sf_dir):
    return label_counts_long(_layer1_docs(spark, sf_dir), "doc_id", "rx_counts")


def q_uncovered_segments(spark, sf_dir):
    df = _layer1_docs(spark, sf_dir)
    seg = uncovered_segments(df, "rx_text", "rx_covered")
    return explode_rows(seg, "segments", "g", "doc_id").select(
        "doc_id",
        F.col("g.seg_start").cast("bigint").alias("seg_start"),
        (F.col("g.seg_start") + F.length("g.seg_text")).cast("bigint").alias("seg_end"),
        F.col("g.seg_text").alias("seg_text"),
    )


# ---- A1, A3, S2 -----------------------------------------------------------
def q_doc_hits(spark, sf_dir):
    return doc_hits(_layer1_docs(spark, sf_dir), "doc_id")


def q_audit(spark, sf_dir):
    return audit(_layer1_docs(spark, sf_dir), "doc_id", "text")


def q_changed_only(spark, sf_dir):
    df = PL.redact(documents(spark, sf_dir), "text", registry=registry(spark, sf_dir), disable_model=True)
    return changed(df).select("doc_id", F.col("redacted").alias("text"))


def q_written_back(spark, sf_dir):
    """The documents after their changed rows were written back; safe to repeat, the folder is
    the session's own."""
    mark = hashlib.sha256(os.path.abspath(sf_dir).encode()).hexdigest()[:8]
    path = f"{ensure_checkpoint_dir(spark)}/written-back-{spark.sparkContext.applicationId}-{mark}"
    base = documents(spark, sf_dir)
    write_back(PL.redact(base, "text", registry=registry(spark, sf_dir), disable_model=True), path, "doc_id", "first")
    return written_back(base, path, "doc_id")


# ---- S3, V7 ---------------------------------------------------------------
def _conversations_redacted(spark, sf_dir):
    return PL.redact(blank_conversations(spark, sf_dir), "text", registry=registry(spark, sf_dir), disable_model=True)


def q_redact_nonblank(spark, sf_dir):
    out = nonblank_redacted(_conversations_redacted(spark, sf_dir))
    return out.select("conv_id", "turn", "variant", F.col("redacted").alias("text"))


def q_blank_docs(spark, sf_dir):
    return _conversations_redacted(spark, sf_dir).select(
        "conv_id", "turn", "variant", F.col("redacted").alias("text"),
        (F.col("mode") == "blank").alias("is_blank"), F.col("regex_hits").cast("bigint").alias("regex_hits"),
    )


# ---- Q1 -------------------------------------------------------------------
def q_pipeline_regex_only(spark, sf_dir):
    from .pipeline import redact

    df = redact(documents(spark, sf_dir), "text", registry=registry(spark, sf_dir), disable_model=True)
    return df.select(
        "doc_id",
        F.col("redacted").alias("text"),
        F.col("regex_hits").cast("bigint").alias("regex_hits"),
        F.col("model_hits").cast("bigint").alias("model_hits"),
        "mode",
        F.col("num_chunks").cast("bigint").alias("num_chunks"),
    )


# ---- C1-C4, A4 --------------------------------------------------------------
def _ranges_query(df, id_col, ranges_fn, idx_name):
    d = df.withColumn("_r", once(ranges_fn(F.coalesce(F.col("text"), F.lit("")))))
    out = posexplode_rows(d, "_r", idx_name, "r", id_col)
    return out.select(
        id_col, F.col(idx_name).cast("bigint").alias(idx_name),
        F.col("r.start").cast("bigint").alias("start"), F.col("r.end").cast("bigint").alias("end"),
    )


def _chunks(text):
    return C.chunk_ranges(text, DEFAULT_CHUNK_SIZE, DEFAULT_OVERLAP)


def q_paragraph_units(spark, sf_dir):
    return _ranges_query(para_docs(spark, sf_dir), "doc_id", C.paragraph_ranges, "unit_idx")


def q_sentence_units(spark, sf_dir):
    return _ranges_query(documents(spark, sf_dir), "doc_id", C.sentence_ranges, "unit_idx")


def q_hard_windows(spark, sf_dir):
    fn = lambda t: C.hard_windows(F.lit(0), F.length(t), DEFAULT_CHUNK_SIZE, DEFAULT_OVERLAP)
    return _ranges_query(documents(spark, sf_dir), "doc_id", fn, "window_idx")


def q_chunk_documents(spark, sf_dir):
    return _ranges_query(documents(spark, sf_dir), "doc_id", _chunks, "chunk_idx")


def q_chunk_para_docs(spark, sf_dir):
    return _ranges_query(para_docs(spark, sf_dir), "doc_id", _chunks, "chunk_idx")


def q_chunk_stats(spark, sf_dir):
    return chunk_stats(q_chunk_documents(spark, sf_dir), "doc_id")


# ---- entity layer: E1-E4, V4-V6, P7-P10, C5, Q2, A2 -------------------------------
def entity_notes(spark, sf_dir):
    t = partial(table, spark, sf_dir)
    return spread_rows(spark.sql(D.ENTITY_NOTES_SQL, customer=t("customer"), nation=t("nation"), region=t("region")))


def entity_terms(spark, sf_dir):
    t = partial(table, spark, sf_dir)
    return spark.sql(D.ENTITY_TERMS_SQL, customer=t("customer"), nation=t("nation"), region=t("region"))


def document_terms(spark, sf_dir):
    return spark.sql(D.DOCUMENT_TERMS_SQL, documents=table(spark, sf_dir, "documents"))


def entity_hits(spark, sf_dir):
    hits = spark.sql(D.ENTITY_HITS_SQL, notes=_note_rows(spark, sf_dir))  # columns cut from text: no work to spread
    return hits.withColumnRenamed("hit_start", "start").withColumnRenamed("hit_end", "end")


#: Inputs of the entity queries: rows, id column, dictionary.
ENTITY_SOURCES = {"notes": (entity_notes, "note_id", entity_terms), "documents": (documents, "doc_id", document_terms)}


def _staged(spark, sf_dir, source):
    rows, id_col, terms = ENTITY_SOURCES[source]
    df = RL.redact_regex(rows(spark, sf_dir), "text", registry(spark, sf_dir), PL.PREFIX)
    return PF.with_chunks(df, RedactConfig()), id_col, E.DictionaryScorer(terms(spark, sf_dir))


def q_chunk_segments(spark, sf_dir, source):
    staged, id_col, _ = _staged(spark, sf_dir, source)
    out = posexplode_rows(staged, PF.CHUNKS, "chunk_idx", "c", id_col)
    return out.select(id_col, F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
                      *_bigint("c.start", "c.end")).toDF(id_col, "chunk_idx", "start", "end")


def _in_row(scorer):
    """The scorer on a document's masked text and covered ranges, whatever the confidence."""
    return PF.row_scorer(scorer, RedactConfig(threshold=0.0))(F.col(PL.PREFIX + "text"), F.col(PL.PREFIX + "covered"))


def _row_hits(staged, id_col, scorer):
    """Hits of a scorer that works in the row."""
    return explode_rows(staged.withColumn("_row", _in_row(scorer)), "_row.hits", "h", id_col).select(id_col, "h.*")


def _chunk_hits(staged, id_col, scorer):
    """Scored rows of any scorer over chunk rows, with the documents' ids for keys."""
    by_id = staged.withColumn(PF.KEY, F.col(id_col).cast("string").cast("binary"))
    scored = PF.scored_rows(by_id, scorer, 0.0)
    return scored.withColumn(id_col, F.col("key").cast("string").cast("bigint"))


def _hits(spark, sf_dir, source, join=False):
    """All hits of the dictionary, by its automaton in the row or (``join``) by joins."""
    staged, id_col, scorer = _staged(spark, sf_dir, source)
    if join:
        scorer.automaton_chars = 0
        return _chunk_hits(staged, id_col, scorer).where(F.col("start").isNotNull()), id_col
    return _row_hits(staged, id_col, scorer), id_col


def q_score_chunks(spark, sf_dir, source, join=False):
    hits, id_col = _hits(spark, sf_dir, source, join)
    return hits.select(id_col, *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "start", "end")], "label", "text", "confidence")


#: A model of limited width: longer chunks fail, and their batch with them until halved.
MODEL_PATTERNS, MODEL_CHARS = {"organization": ("[A-Z][a-z]{5,}", 0.8), "person": ("[a-z]+ble [a-z]+", 0.9)}, 1500


def q_score_chunks_model(spark, sf_dir, source):
    staged, id_col, _ = _staged(spark, sf_dir, source)
    rows = _chunk_hits(staged, id_col, E.PatternScorer(MODEL_PATTERNS, MODEL_CHARS))
    rows = rows.where(F.col("start").isNotNull() | F.col("error").isNotNull())
    return rows.select(id_col, *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "start", "end", "hit_idx")], "error", "label", "text")


def q_remap_offsets(spark, sf_dir, source):
    hits, id_col = _hits(spark, sf_dir, source)
    return E.remap(hits).select(id_col, *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "start", "end")], "label")


def _pipeline_full(spark, sf_dir, source):
    rows, id_col, terms = ENTITY_SOURCES[source]
    return PL.redact(rows(spark, sf_dir), "text", registry=registry(spark, sf_dir), disable_model=False,
                     scorer=E.DictionaryScorer(terms(spark, sf_dir))), id_col


def q_chunks_scored(spark, sf_dir, source):
    df, id_col = _pipeline_full(spark, sf_dir, source)
    return df.select(id_col, *[F.col(c).cast("bigint").alias(c) for c in ("num_chunks", "scored_chunks")])


def q_pipeline_full(spark, sf_dir, source):
    df, id_col = _pipeline_full(spark, sf_dir, source)
    return df.select(
        id_col, F.col("redacted").alias("text"),
        F.col("regex_hits").cast("bigint").alias("regex_hits"),
        F.col("model_hits").cast("bigint").alias("model_hits"),
        "mode", F.col("num_chunks").cast("bigint").alias("num_chunks"),
    )


def q_run_summary(spark, sf_dir, source):
    return run_summary(_pipeline_full(spark, sf_dir, source)[0], {"regex": "regex_counts", "model": "model_counts"})


def q_audit_full(spark, sf_dir, source):
    df, id_col = _pipeline_full(spark, sf_dir, source)
    return full_audit(df, id_col, "text").drop("run_id", "error_types")


def q_error_summary(spark, sf_dir, source):
    rows, _, _ = ENTITY_SOURCES[source]
    df = PL.redact(rows(spark, sf_dir), "text", registry=registry(spark, sf_dir), disable_model=False, scorer=E.PatternScorer(MODEL_PATTERNS, MODEL_CHARS))
    return error_summary(df)


# ---- the entity layer's steps one by one, over hits that overlap each other and layer 1 ----
def document_hits(spark, sf_dir):
    """The dictionary's hits in the documents, widened so that they meet what is beside them."""
    hits, id_col = _hits(spark, sf_dir, "documents")
    hits = E.remap(hits)
    return hits.select(id_col, "chunk_idx", "hit_idx", (F.col("start") - F.col("start") % 7).alias("start"), (F.col("end") + F.col("end") % 41).alias("end"), "label", "text", "confidence")


#: Inputs of these queries: hits, their documents, id column.
HIT_SOURCES = {"notes": (entity_hits, notes, "note_id"), "documents": (document_hits, documents, "doc_id")}


def _hits_of(spark, sf_dir, source, keep):
    hits, _, id_col = HIT_SOURCES[source]
    return hits(spark, sf_dir).where(keep).select(
        id_col, *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "hit_idx", "start", "end")],
        "label", "text", "confidence",
    )


def q_entity_threshold(spark, sf_dir, source):
    return _hits_of(spark, sf_dir, source, E.confident(RedactConfig().threshold))


def q_entity_stopwords(spark, sf_dir, source):
    return _hits_of(spark, sf_dir, source, E.not_stopword())


def q_label_filter(spark, sf_dir, source):
    return _hits_of(spark, sf_dir, source, E.known_label())


def _filtered_hits(spark, sf_dir, source):
    hits, rows, id_col = HIT_SOURCES[source]
    h = E.filter_hits(hits(spark, sf_dir), RedactConfig().threshold)
    return h.withColumn("label_idx", F.array_position(F.array(*[F.lit(x) for x in P.ENTITY_LABELS]), F.col("label")).cast("int") - 1), rows, id_col


def q_merged_spans(spark, sf_dir, source):
    h, _, id_col = _filtered_hits(spark, sf_dir, source)
    return ST.merge_table(h, id_col, ["chunk_idx", "label_idx", "hit_idx"]).select(id_col, *_bigint("start", "end"), "label")


def q_covered_guard(spark, sf_dir, source):
    _, rows, id_col = HIT_SOURCES[source]
    merged = q_merged_spans(spark, sf_dir, source)
    cov = explode_rows(_layer1_docs(spark, sf_dir, rows), "rx_covered", "c", id_col).select(
        id_col, F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"))
    return ST.guard_table(merged, cov, id_col)


def q_redact_entities(spark, sf_dir, source="notes"):
    h, rows, id_col = _filtered_hits(spark, sf_dir, source)
    spans = h.groupBy(id_col).agg(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), (F.col("start") - F.col("end")).cast("int").alias("neg_len"),
        F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("label_idx").alias("label_idx"),
        F.col("hit_idx").cast("int").alias("hit_idx"), F.col("end").cast("int").alias("end"), F.col("label"),
    )).alias("hits"))
    l1 = _layer1_docs(spark, sf_dir, rows).join(spans, id_col, "left")
    l1 = l1.withColumn("hits", F.coalesce("hits", F.array().cast(E.ESPAN_ARRAY)))
    l1 = l1.withColumn("kept", E.greedy(E.guard(E.merge_contained(F.col("hits")), F.col("rx_covered"))))
    return l1.select(id_col, mask(F.col("rx_text"), F.col("kept"), E.upper_placeholder).alias("text"),
                     F.size("kept").cast("bigint").alias("model_hits"))


def q_redact_entities_documents(spark, sf_dir):
    """As ``redact_entities`` over ``document_hits``, in the documents' rows."""
    staged, id_col, scorer = _staged(spark, sf_dir, "documents")
    text, hits = F.col(PL.PREFIX + "text"), E.kept_in_row(_in_row(scorer)["hits"], RedactConfig().threshold)

    def widened(s):
        start, end = s["start"] - s["start"] % 7, s["end"] + s["end"] % 41
        return s.withField("start", start).withField("end", end).withField("neg_len", start - end)

    out = staged.withColumn("hits", once(F.transform(hits, widened)))
    out = out.withColumn("kept", once(E.greedy(E.guard(E.merge_contained(F.col("hits")), F.col(PL.PREFIX + "covered")))))
    return out.select(id_col, mask(text, F.col("kept"), E.upper_placeholder).alias("text"), F.size("kept").cast("bigint").alias("model_hits"))


# ---- P2, P4, P6 over span tables ---------------------------------------------------
def _resolved_table(spark, sf_dir):
    return ST.resolve_table(q_all_spans(spark, sf_dir), "doc_id")


def q_resolved_spans_table(spark, sf_dir):
    return _resolved_table(spark, sf_dir).select("doc_id", "start", "end", "label")


def q_covered_ranges_table(spark, sf_dir):
    return ST.covered_table(_resolved_table(spark, sf_dir), "doc_id").select("doc_id", "out_start", "out_end", "label")


def q_uncovered_segments_table(spark, sf_dir):
    df = _layer1_docs(spark, sf_dir)
    cov = explode_rows(df, "rx_covered", "c", "doc_id").select("doc_id", "c.start", "c.end")
    gaps = ST.uncovered_table(cov, df.select("doc_id", F.length("rx_text").alias("length")), "doc_id")
    return gaps.select("doc_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))


# ---- long texts by slice (slices so short that most documents have several) --------------
SLICE = 500


def q_all_spans_sliced(spark, sf_dir):
    return LT.long_candidates(documents(spark, sf_dir), "doc_id", "text", registry(spark, sf_dir), SLICE)


def q_redact_sliced(spark, sf_dir):
    out = LT.redact_long(documents(spark, sf_dir), "doc_id", "text", registry(spark, sf_dir), SLICE)
    return out.select("doc_id", F.col("redacted").alias("text"))


def q_detect_address_sliced(spark, sf_dir):
    found = LT.long_candidates(form_notes(spark, sf_dir), "note_id", "text", registry(spark, sf_dir), 20)
    return found.where("label = 'ADDRESS'").select("note_id", "start", "end", "label")


# ---- SQL surface ---------------------------------------------------------------------
def q_redact_text_sql(spark, sf_dir):
    sql.register(spark, registry(spark, sf_dir))
    return spark.sql("select doc_id, redact_text(text) as text from {docs}", docs=documents(spark, sf_dir))


def q_redact_spans_sql(spark, sf_dir):
    sql.register(spark, registry(spark, sf_dir))
    return spark.sql(
        "select doc_id, cast(s.start as bigint) as start, cast(s.end as bigint) as end, s.label from (select doc_id, explode(redact_spans(text)) as s from {docs})",
        docs=documents(spark, sf_dir))


def q_label_counts_sql(spark, sf_dir):
    sql.register(spark, registry(spark, sf_dir))
    return spark.sql("select doc_id, label, cast(n as bigint) as n from (select doc_id, explode(redact_counts(text)) as (label, n) from {docs})", docs=documents(spark, sf_dir))


def _chunk_text(spark, sf_dir, source):
    sql.register(spark, registry(spark, sf_dir))
    return spark.sql(f"select * from chunk_text(table({{docs}}), {DEFAULT_CHUNK_SIZE}, {DEFAULT_OVERLAP})", docs=source(spark, sf_dir))


DETECT_SOURCES = {
    "EMAIL": ("detect_email", documents, "doc_id"),
    "PHONE": ("detect_phone", documents, "doc_id"),
    "PAN": ("detect_pan", notes, "note_id"),
    "AADHAAR": ("detect_aadhaar", notes, "note_id"),
    "UPI": ("detect_upi", notes, "note_id"),
    "IP": ("detect_ip", documents, "doc_id"),
    "SECRET": ("detect_secret", documents, "doc_id"),
    "LONGNUM": ("detect_longnum", documents, "doc_id"),
    "ADDRESS": ("detect_address", notes, "note_id"),
    "SSN": ("detect_ssn", notes, "note_id"),
    "POSTAL_CODE": ("detect_postal", notes, "note_id"),
}


ENTITY_QUERIES = {
    "chunk_segments": q_chunk_segments,
    "score_chunks": q_score_chunks,
    "remap_offsets": q_remap_offsets,
    "chunks_scored": q_chunks_scored,
    "pipeline_full": q_pipeline_full,
    "run_summary": q_run_summary,
    "audit_full": q_audit_full,
    "score_chunks_join": partial(q_score_chunks, join=True),
    "score_chunks_model": q_score_chunks_model,
    "error_summary": q_error_summary,
    "entity_threshold": q_entity_threshold,
    "entity_stopwords": q_entity_stopwords,
    "label_filter": q_label_filter,
    "merged_spans": q_merged_spans,
    "covered_guard": q_covered_guard,
    "redact_entities": q_redact_entities,
}


def registered() -> dict:
    q = {"source_text": q_source_text}
    for label, (key, src, idc) in DETECT_SOURCES.items():
        q[key] = partial(q_detect, label=label, source=src, id_col=idc)
    q["address_form_excluded"] = partial(q_detect, label="ADDRESS", source=form_notes, id_col="note_id")
    q["ssn_rules"] = partial(q_detect, label="SSN", source=ssn_notes, id_col="note_id")
    q.update(
        pin_semi_join=q_pin_semi_join,
        all_spans=q_all_spans,
        resolved_spans=q_resolved_spans,
        redact_regex=q_redact_regex,
        covered_ranges=q_covered_ranges,
        label_counts=q_label_counts,
        uncovered_segments=q_uncovered_segments,
        doc_hits=q_doc_hits,
        audit=q_audit,
        changed_only=q_changed_only,
        written_back=q_written_back,
        redact_nonblank=q_redact_nonblank,
        blank_docs=q_blank_docs,
        pipeline_regex_only=q_pipeline_regex_only,
        paragraph_units=q_paragraph_units,
        sentence_units=q_sentence_units,
        hard_windows=q_hard_windows,
        chunk_documents=q_chunk_documents,
        chunk_para_docs=q_chunk_para_docs,
        chunk_stats=q_chunk_stats,
        all_spans_sliced=q_all_spans_sliced,
        redact_sliced=q_redact_sliced,
        detect_address_sliced=q_detect_address_sliced,
        redact_text_sql=q_redact_text_sql,
        redact_spans_sql=q_redact_spans_sql,
        label_counts_sql=q_label_counts_sql,
        chunk_text_sql=partial(_chunk_text, source=documents),
        chunk_text_para_sql=partial(_chunk_text, source=para_docs),
        resolved_spans_table=q_resolved_spans_table,
        covered_ranges_table=q_covered_ranges_table,
        uncovered_segments_table=q_uncovered_segments_table,
    )
    for key, fn in ENTITY_QUERIES.items():
        q[key] = partial(fn, source="notes")
        q[key + "_documents"] = partial(fn, source="documents")
    q["redact_entities_documents"] = q_redact_entities_documents
    return q
