"""The streaming job gives the batch result and resumes where it stopped."""

import os
import time

import pytest

from conftest import SF_SMALL
from spanmask.functions.detectors import PinRegistry
from spanmask.operators.aggregates import error_summary, run_metrics
from spanmask.operators.entities import DictionaryScorer, Scorer
from spanmask.plans.pipeline import redact
from spanmask.plans.pipeline_full import release
from spanmask.streaming.stream import read_text_stream, redact_stream
from spanmask.streaming.totals import RunTotals

COLUMNS = ["conv_id", "turn", "redacted", "regex_hits", "model_hits", "num_chunks"]


def _same(got, want):
    got, want = got.select(COLUMNS), want.select(COLUMNS)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("with_scorer", [False, True])
def test_a_restarted_stream_goes_on(spark, scratch, with_scorer):
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    turns.where("conv_id % 2 = 0").coalesce(1).write.parquet(src)
    reg = PinRegistry(["560068"])
    scorer = DictionaryScorer(spark.createDataFrame([("the", "person", 0.9), ("and", "city", 0.8)], "term string, label string, confidence double")) if with_scorer else None

    def run():
        stream = read_text_stream(spark, src, turns.schema, max_files_per_trigger=1)
        redact_stream(stream, out, registry=reg, scorer=scorer, checkpoint=os.path.join(scratch, "ckpt")).awaitTermination(300)
        return spark.read.parquet(out)

    def batch():
        return redact(spark.read.parquet(src), "text", registry=reg, disable_model=not with_scorer, scorer=scorer)

    _same(run(), batch())
    turns.where("conv_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    _same(run(), batch())
    _same(run(), batch())


def test_the_place_of_the_checkpoint_must_be_fixed(spark, scratch):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    with pytest.raises(ValueError, match="checkpoint or query_name"):
        redact_stream(read_text_stream(spark, scratch, turns.schema), scratch)


@pytest.mark.parametrize("kind", ["none", "dictionary", "model"])
def test_totals_of_a_stream_are_those_of_the_batch(spark, scratch, kind):
    class Failing(Scorer):
        """A model that works by chunk rows and fails on some texts, by type."""

        def score(self, model, text, labels, threshold):
            if "the" in text:
                raise KeyError("the") if "and" in text else ValueError("no and")
            return [{"label": "person", "start": 0, "end": 1, "text": text[0], "confidence": 1.0}]

    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    turns.repartition(3).write.parquet(src)
    terms = spark.createDataFrame([("the", "person", 0.9), ("and", "city", 0.8)], "term string, label string, confidence double")
    scorer = {"none": None, "dictionary": DictionaryScorer(terms), "model": Failing()}[kind]
    mine = spark.range(5).cache()
    mine.count()
    totals = RunTotals()
    spark.streams.addListener(totals)
    try:
        stream = read_text_stream(spark, src, turns.schema, max_files_per_trigger=1)
        redact_stream(stream, out, scorer=scorer, checkpoint=os.path.join(scratch, "ckpt"), totals=totals).awaitTermination(300)
        for _ in range(100):
            if totals.totals["docs"] >= turns.count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    batch = redact(turns, "text", scorer=scorer, disable_model=scorer is None)
    want = batch.agg(*run_metrics()).first().asDict()
    assert dict(totals.totals) == {k: v for k, v in want.items()} | {k: 0 for k in totals.totals if k not in want} and totals.batches == 3
    assert dict(totals.errors) == {r["error"]: r["n"] for r in error_summary(batch).collect()}
    assert (kind == "model") == bool(totals.errors)
    # the caller's cached tables stay
    assert mine.storageLevel.useMemory
    release(batch)
    mine.unpersist()
