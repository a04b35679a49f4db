"""Layer 1 by slices equals layer 1 in the row, wherever slices are cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

import pycheck
from conftest import SF_SMALL
from spanmask.functions import patterns as P
from spanmask.functions.detectors import PinRegistry
from spanmask.operators import long_texts as L
from spanmask.operators.regex_layer import redact_regex, with_candidates

PINS = ["560068", "110001"]
PARTS = ["a.b@mail.example.com", "+91 98765 43210", "(415) 555-0199", "ABCDE1234F", "2345 6789 0123", "x@okbank", "10.0.0.7", "sk_" + "Ab1" * 9, "4111-1111-1111-1111", "123-45-6789",
         "560068", "999999", "12345", " ", "\n", "\n\n", ", ", "é", "; ", ": ", "'", "١" * 5, "Flat 12B, Rose Court,\n4th Cross, Lakeside,\nBengaluru 560068", "State: Karnataka", "Floor No.: 3\n", "word ", "﷐", "\U0001f600"]


def _texts(seed, n):
    rng = random.Random(seed)
    return [None, "", " ", ";"] + ["".join(rng.choice(PARTS) + rng.choice(("", " ", "\n", "; ", "é")) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 60, 1000])
def test_slices_equal_rows(spark, size):
    df = spark.createDataFrame(list(enumerate(_texts(size, 150))), "id long, text string").repartition(3)
    reg = PinRegistry(PINS)
    want = with_candidates(df, "text", reg, name="c").select("id", F.explode("c").alias("c")).select("id", "c.start", "c.end", "c.label")
    got = L.long_candidates(df, "id", "text", reg, size).select("id", "start", "end", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = {r["id"]: r["rx_text"] for r in redact_regex(df, "text", reg).collect()}
    out = L.redact_long(df, "id", "text", reg, size)
    assert {r["id"]: r["redacted"] for r in out.collect()} == whole


def test_slices_are_the_text(spark):
    text = "".join(t or "" for t in _texts(9, 100))
    rows = L.slices(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 50).orderBy("slice").collect()
    assert "".join(r["text"][r["before"] :] for r in rows) == text and len(rows) > 20
    assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
    assert all(len(r["text"]) == r["length"] + r["before"] for r in rows)


def test_no_match_holds_a_character_to_cut_at():
    plain = re.compile(r"[A-Za-z0-9\d\s,._%+@()/\-]*")
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) + rng.choice(("", " ", "\n")) for _ in range(20))
        for start, end, label in pycheck.candidates(text, frozenset(PINS)):
            assert plain.fullmatch(text[start:end]), label


def test_labelled_forms_reach_into_later_slices(spark):
    # the address starts in one slice, the form line that blocks it lies eight lines on
    address = "Flat 12B, Rose Court,\n4th Cross, Lakeside,\nBengaluru 560068"
    texts = [f"; {address};" + "\n;x;" * n + "\nDistrict é : y" for n in range(12)] + [f"; {address};" + "z;" * 4000 + "\nState: y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = L.long_candidates(df, "id", "text", PinRegistry(PINS), 5).where("label = 'ADDRESS'")
    want = with_candidates(df, "text", PinRegistry(PINS), name="c").select("id", F.explode("c").alias("c")).where("c.label = 'ADDRESS'")
    found = sorted(r["id"] for r in got.collect())
    assert found == sorted(r["id"] for r in want.collect()) and 0 < len(found) < len(texts)


def test_one_long_text_is_scanned_by_many_tasks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    text = "; ".join(r["text"] or "" for r in docs)
    text = text * (5_000_000 // len(text) + 1)
    df = spark.createDataFrame([(1, text)], "id long, text string")
    reg = PinRegistry(PINS)
    out = L.redact_slices(df, "id", "text", reg, 1 << 16, 8)
    tasks = out.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.length("redacted")).alias("n")).collect()
    assert len(tasks) >= 6 and max(r["n"] for r in tasks) < 0.5 * len(text)
    assert L.redact_long(df, "id", "text", reg, 1 << 16, 8).first()["redacted"] == redact_regex(df, "text", reg).first()["rx_text"]


def test_every_detector_is_covered():
    assert set(P.DETECTOR_ORDER) == {"EMAIL", "PHONE", "PAN", "AADHAAR", "UPI", "IP", "SECRET", "LONGNUM", "ADDRESS", "SSN", "POSTAL_CODE"}
