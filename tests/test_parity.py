"""Spark spans equal Python-re spans on raw text: the supplied documents and
hand-made Unicode edge cases (accents, combining marks, emoji, non-ASCII digits,
unusual whitespace, a text already holding the sentinel)."""

import re
import time

from pyspark.sql import functions as F

import pycheck
from conftest import SF_SMALL
from spanmask.functions import patterns as P
from spanmask.functions.detectors import PinRegistry
from spanmask.operators.regex_layer import redact_regex

REG = frozenset({"560068"})

EDGE = [
    None,
    "",
    "   \n ",
    "café user@mail.example.com",
    "éuser@mail.example.com",
    "x́ 9123456780 and é192.168.0.1",
    "emoji 😀9123456780😀 and 𝐀9123456780",
    "digits ३२०००००००० and ٩١٢٣٤٥٦٧٨٠",
    "sep 2345\u001c6789\u001c0123 and 2345\u00856789\u00850123 and 2345 6789 0123",
    "sentinel ﷐ inside 9123456780 and ﷑﷒ user@mail.example.com",
    "".join(chr(c) for c in range(0xFDD0, 0xFDF0)) + " 9123456780 " + chr(0xFDD0) + "a.b@mail.example.com" + chr(0xFDD0),
    "newer letters \u0870user@mail.example.com \U000313509123456780 \U00011f50\U00011f51\U00011f52\U00011f53\U00011f54",
    "token_abcdefghijklmnopqrstuvwxyz-0123 and über_abcdefghijklmnopqrstuvwxyz",
    "²9123456780 and 9123456780²",
    "Plot 7B, Maple Court,\n2nd Main, Lakeside,\nBengaluru 560068\nState: Karnataka",
    "Plot 7B, Maple Court,\n2nd Main, Lakeside,\nBengaluru 560068, Karnataka and PIN 560068",
]


def _check(rows):
    bad = []
    for key, text, out, spans in rows:
        exp_text, exp_kept, _ = pycheck.redact(text, REG)
        got = [(s["start"], s["end"], s["label"]) for s in spans]
        if out != exp_text or got != exp_kept:
            bad.append((key, got[:5], exp_kept[:5]))
    assert not bad, bad[:3]


def test_edge_texts(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)), "id long, text string")
    out = redact_regex(df, "text", PinRegistry(REG)).collect()
    _check([(r["id"], r["text"], r["rx_text"], r["rx_spans"]) for r in out])


def test_documents_sf0001(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = redact_regex(df, "text", PinRegistry(REG)).collect()
    assert len(out) == 200
    _check([(r["doc_id"], r["text"], r["rx_text"], r["rx_spans"]) for r in out])


def test_pages_html(spark):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", F.col("html").alias("text"))
    out = redact_regex(df, "text", PinRegistry(REG)).collect()
    _check([(r["page_id"], r["text"], r["rx_text"], r["rx_spans"]) for r in out])


def test_properties(spark):
    """Kept spans are sorted and disjoint; placeholders sit at the covered ranges;
    removing them leaves exactly the unmasked pieces."""
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for r in redact_regex(df, "text", PinRegistry(REG)).collect():
        spans, cov, out = r["rx_spans"], r["rx_covered"], r["rx_text"]
        for a, b in zip(spans, spans[1:]):
            assert a["end"] <= b["start"]
        pieces, cur = [], 0
        for s, c in zip(spans, cov):
            assert out[c["start"]:c["end"]] == f"[{s['label']}]"
            pieces.append(r["text"][cur:s["start"]])
            cur = s["end"]
        pieces.append(r["text"][cur:])
        rest, cur = [], 0
        for c in cov:
            rest.append(out[cur:c["start"]])
            cur = c["end"]
        rest.append(out[cur:])
        assert rest == pieces


def test_every_code_point_has_pythons_class(spark):
    """Digits, space and word characters of the Java classes are those of Python."""
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = spark.range(0x110000).where("id < 55296 or id >= 57344").select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    kinds = {"d": P.JAVA_DIGIT_BODY, "s": P.JAVA_SPACE_BODY, "w": P.JAVA_WORD_BODY}
    rows = chars.select("id", *(F.col("c").rlike(f"^[{body}]$").alias(k) for k, body in kinds.items())).where("d or s or w").collect()
    for k in kinds:
        assert {r["id"] for r in rows if r[k]} == {c for c in cps if re.match(rf"\{k}", chr(c))}


def test_cost_grows_with_the_length(spark):
    """Twice the matches in one text take about twice the time, at most."""
    from spanmask.plans.pipeline import redact

    def seconds(n):
        df = spark.createDataFrame([(f"see 10.0.0.{i % 250} and a{i}@mail.example.com. " for i in range(1)).__next__() * n], "string").toDF("text")
        t = time.perf_counter()
        row = redact(df, "text", disable_model=True).select("regex_hits", F.length("redacted")).first()
        assert row["regex_hits"] == 2 * n
        return time.perf_counter() - t

    seconds(10)
    small, large = seconds(5_000), seconds(20_000)
    assert large < 4 * small * 2 + 2, (small, large)
