"""Q4 config loading and Q5 run id, in the shape of the reference's config tests."""

import math
import re

import pytest
from pyspark.sql import functions as F

from spanmask import config as C
from spanmask.operators.entities import Scorer
from spanmask.operators.regex_layer import redact_regex
from spanmask.plans.pipeline import redact


def test_defaults():
    cfg = C.load_config({})
    assert cfg.model_id == C.DEFAULT_MODEL_ID
    assert cfg.threshold == C.DEFAULT_THRESHOLD
    assert cfg.disable_model is False


def test_custom_values():
    cfg = C.load_config({C.KEY_MODEL_ID: "my/model", C.KEY_THRESHOLD: "0.25"})
    assert cfg.model_id == "my/model" and cfg.threshold == 0.25
    assert C.load_config({C.KEY_MODEL_ID: "   "}).model_id == C.DEFAULT_MODEL_ID


@pytest.mark.parametrize("raw", ["not-a-number", "1.5", "-0.1", "nan"])
def test_invalid_threshold(raw):
    with pytest.raises(ValueError, match=re.escape(C.KEY_THRESHOLD)):
        C.load_config({C.KEY_THRESHOLD: raw})


@pytest.mark.parametrize("raw,expected", [("1", True), (" TRUE ", True), ("yes", True), ("On", True),
                                          ("0", False), ("no", False), ("", False)])
def test_disable_flag(raw, expected):
    assert C.load_config({C.KEY_DISABLE_MODEL: raw}).disable_model is expected


def test_run_id():
    a, b = C.new_run_id(), C.new_run_id()
    assert re.fullmatch(r"[0-9a-f]{12}", a) and a != b


class _MustNotRun(Scorer):
    name = "never"

    def load(self):
        raise AssertionError("model path should not run")


def test_disabled_model_equals_layer_one(spark):
    df = spark.createDataFrame([(1, "Email me at someone@example.com")], "id long, text string")
    expected = redact_regex(df, "text").first()
    cfg = C.load_config({C.KEY_DISABLE_MODEL: "true"})
    got = redact(df, "text", config=cfg, scorer=_MustNotRun()).first()
    assert got["redacted"] == expected["rx_text"]
    assert dict(got["regex_counts"]) == dict(expected["rx_counts"])
    assert dict(got["model_counts"]) == {}
    assert got["mode"] == "disabled" and got["num_chunks"] == got["scored_chunks"] == 0 and got["model_errors"] == []


def test_blank_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t\u0085 ")], "id long, text string")
    rows = {r["id"]: r for r in redact(df, "text", disable_model=True).collect()}
    assert rows[1]["redacted"] == "" and rows[2]["redacted"] == ""
    assert rows[3]["redacted"] == " \n\t\u0085 "
    assert all(r["mode"] == "blank" and dict(r["regex_counts"]) == {} for r in rows.values())


def test_run_metrics_observed(spark):
    from spanmask.operators.aggregates import observe_run

    df = spark.createDataFrame([(1, "mail a.b@mail.example.com"), (2, "nothing")], "id long, text string")
    out, obs = observe_run(redact(df, "text", disable_model=True), C.new_run_id())
    out.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert m["docs"] == 2 and m["regex_hits"] == 1 and m["changed_docs"] == 1


def test_one_schema_for_all_modes(spark):
    class Nothing(Scorer):
        def score(self, model, text, labels, threshold):
            return []

    df = spark.createDataFrame([(1, "text"), (2, " ")], "id long, text string")
    assert redact(df, disable_model=True).dtypes == redact(df, scorer=Nothing(), disable_model=False).dtypes


def test_input_columns_stay_and_clashes_are_errors(spark):
    df = spark.createDataFrame([(1, "mail a.b@mail.example.com", "MINE", "x", "y")], "id long, text string, rx_text string, chunks string, spans string")
    row = redact(df, disable_model=True).first()
    assert (row["rx_text"], row["chunks"], row["spans"]) == ("MINE", "x", "y")
    with pytest.raises(ValueError, match="redacted"):
        redact(df.withColumn("Redacted", F.lit(1)), disable_model=True)
    with pytest.raises(ValueError, match="rx_text"):
        redact_regex(df, "text")


def test_chunk_settings():
    cfg = C.load_config({C.KEY_CHUNK_SIZE: "50", C.KEY_OVERLAP: "0", "other": "x", C.KEY_THRESHOLD: None})
    assert (cfg.chunk_size, cfg.overlap, cfg.threshold) == (50, 0, C.DEFAULT_THRESHOLD)
    for key, raw in ((C.KEY_CHUNK_SIZE, "0"), (C.KEY_CHUNK_SIZE, "1.5"), (C.KEY_OVERLAP, "-1")):
        with pytest.raises(ValueError, match=re.escape(key)):
            C.load_config({key: raw})


def test_full_audit_counts_both_layers(spark):
    from spanmask.operators.aggregates import full_audit

    class Fails(Scorer):
        def score(self, model, text, labels, threshold):
            if "bad" in text:
                raise KeyError("x")
            return [{"label": "person", "start": 0, "end": 3, "text": text[:3], "confidence": 0.9}]

    df = spark.createDataFrame([(1, "Ann mail a.b@mail.example.com now"), (2, "bad one"), (3, "")], "id long, text string")
    run_id = C.new_run_id()
    rows = {r["id"]: r for r in full_audit(redact(df, scorer=Fails(), disable_model=False), "id", "text", run_id).collect()}
    assert (rows[1]["regex_hits"], rows[1]["model_hits"], rows[1]["num_chunks"], rows[1]["scored_chunks"], rows[1]["failed_chunks"]) == (1, 2, 2, 2, 0)
    assert (rows[2]["model_hits"], rows[2]["failed_chunks"], rows[2]["changed"]) == (0, 1, False)
    assert rows[3]["mode"] == "blank" and {r["run_id"] for r in rows.values()} == {run_id}
