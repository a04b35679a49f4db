"""Golden cases in the shape of the reference's detector tests (texts of our own),
plus the detectors it leaves untested.  All cases run as one Spark job."""

import pytest
from pyspark.sql import functions as F

import pycheck
from spanmask.functions.detectors import PinRegistry
from spanmask.operators.regex_layer import redact_regex

REG = frozenset({"110001"})

LABELLED_FORM = """CERTIFICATE OF RESIDENCE
To,
Jane Roe
Floor No.: 3RD Floor
Building No./Flat No.: B-204
Name Of Premises/Building: Green Park Towers
Road/Street: Ring Road, Sector Gate,
Locality/Sub Locality: Lajpat Nagar
City/Town/Village: New Delhi
District: South Delhi
State: Delhi
PIN Code: 110001"""
FREE_FORM = "House 12A, Lotus Residency,\n5th Main, Jayanagar,\nNew Delhi 110001"
STREET_WITH_KEYWORD = "House 12A, State Bank Colony,\n5th Main, Jayanagar,\nNew Delhi 110001"

# case -> (text, expected counts, must contain, must not contain)
CASES = {
    "in_mobile_cc": ("Reach me on +91 91234 56789 today", {"PHONE": 1}, [], ["91234"]),
    "in_mobile_bare": ("Dial 9123456780", {"PHONE": 1}, [], []),
    "in_landline": ("Office line 044-28765432", {"PHONE": 1}, [], []),
    "us_parens": ("Ring (312) 555-0199", {"PHONE": 1}, [], []),
    "us_cc": ("Ring +1 312 555 0199", {"PHONE": 1}, [], []),
    "us_dashes": ("Ring 312-555-0199", {"PHONE": 1}, [], []),
    "us_dots": ("Ring 312.555.0199", {"PHONE": 1}, [], []),
    "ssn_ok": ("ID 234-56-7890", {"SSN": 1}, [], []),
    "ssn_area_000": ("Bad: 000-45-6789", {}, [], []),
    "ssn_area_666": ("Bad: 666-45-6789", {}, [], []),
    "ssn_area_9xx": ("Bad: 912-45-6789", {}, [], []),
    "ssn_group_00": ("Bad: 234-00-6789", {}, [], []),
    "ssn_serial_0000": ("Bad: 234-56-0000", {}, [], []),
    "email": ("Mail jane.doe@sample.org please", {"EMAIL": 1}, [], []),
    "order_and_date": ("Order #9123456780 on 2023-11-05.", None, ["2023-11-05"], []),
    "pin_alone": ("PIN 110001", {"POSTAL_CODE": 1}, [], []),
    "pin_labelled": ("PIN Code: 110001", {"POSTAL_CODE": 1}, ["PIN Code:", "[POSTAL_CODE]"], ["110001"]),
    "pin_in_address": (FREE_FORM, {"ADDRESS": 1}, [], []),
    "pin_999999": ("Bad PIN 999999", None, [], []),
    "pin_unregistered": ("Other PIN 123456", None, ["123456"], []),
    "zip_alone": ("ZIP 10001", {"POSTAL_CODE": 1}, [], []),
    "zip_city_state": ("Austin TX 73301", {"POSTAL_CODE": 1}, [], ["73301"]),
    "labelled_form": (LABELLED_FORM, None, ["Floor No.:", "Locality/Sub Locality:", "PIN Code:"], []),
    "free_form": (FREE_FORM, {"ADDRESS": 1}, ["[ADDRESS]"], []),
    "street_keyword": (STREET_WITH_KEYWORD, {"ADDRESS": 1}, ["[ADDRESS]"], []),
    "pan": ("PAN ABCDE1234F on file", {"PAN": 1}, [], []),
    "aadhaar": ("UID 2345 6789 0123 noted", {"AADHAAR": 1}, [], []),
    "upi": ("pay to name.k@okaxis now", {"UPI": 1}, [], []),
    "ip": ("from 192.168.1.10 at noon", {"IP": 1}, [], []),
    "secret": ("key sk_live_abcdefghijklmnopqrstuvwx end", {"SECRET": 1}, [], []),
    "longnum": ("card 4111 1111 1111 1111 used", {"LONGNUM": 1}, [], []),
    "tie_aadhaar_longnum": ("id 234567890123 twice", {"AADHAAR": 1}, [], []),
    "tie_leading_zero": ("id 012345678901 twice", {"PHONE": 1}, [], []),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(k, v[0]) for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "case_id string, text string")
    out = redact_regex(df, "text", PinRegistry(REG))
    return {r["case_id"]: r for r in out.select("case_id", "rx_text", "rx_counts", "rx_spans").collect()}


@pytest.mark.parametrize("case_id", list(CASES))
def test_golden(results, case_id):
    text, counts, must, must_not = CASES[case_id]
    r = results[case_id]
    got = dict(r["rx_counts"])
    if counts is not None:
        assert got == counts
    for s in must:
        assert s in r["rx_text"]
    for s in must_not:
        assert s not in r["rx_text"]
    # and the independent checker on Python's re agrees exactly
    exp_text, exp_kept, exp_counts = pycheck.redact(text, REG)
    assert r["rx_text"] == exp_text
    assert [(s["start"], s["end"], s["label"]) for s in r["rx_spans"]] == exp_kept


def test_specific_negatives(results):
    assert "ADDRESS" not in dict(results["labelled_form"]["rx_counts"])
    assert "POSTAL_CODE" not in dict(results["pin_999999"]["rx_counts"])
    assert "POSTAL_CODE" not in dict(results["pin_unregistered"]["rx_counts"])
    assert "POSTAL_CODE" not in dict(results["pin_in_address"]["rx_counts"])


def test_missing_registry_fails_closed(spark):
    df = spark.createDataFrame([("PIN 110001 and " + FREE_FORM,)], "text string")
    r = redact_regex(df, "text", None).first()
    assert "POSTAL_CODE" not in dict(r["rx_counts"]) and "ADDRESS" not in dict(r["rx_counts"])


def test_registry_tables_of_any_size(spark):
    df = spark.createDataFrame([("PIN 110001 and PIN 700001 and PIN 899999 and PIN 100000",)], "text string")
    for pins in (range(100_000, 160_001), range(100_000, 900_000)):
        table = spark.range(pins.start, pins.stop).selectExpr("concat(' ', cast(id as string)) as pin").union(spark.createDataFrame([("junk",), (None,), ("999999",)], "pin string"))
        r = redact_regex(df, "text", PinRegistry.from_table(table)).first()
        assert dict(r["rx_counts"]) == {"POSTAL_CODE": sum(p in pins for p in (110001, 700001, 899999, 100000))}


def test_unreadable_registry_table_raises(spark):
    with pytest.raises(Exception, match="no_such_table"):
        redact_regex(spark.createDataFrame([("x",)], "text string"), "text", PinRegistry.from_table(spark.table("no_such_table"))).collect()


def test_forms_with_long_lines(spark):
    long_line = "x" * 9000
    blocked = FREE_FORM.replace("House", "House") + "\n" + long_line + "\nState: Delhi"
    clear = FREE_FORM + "\n" + long_line + "\nnothing"
    df = spark.createDataFrame([(1, blocked), (2, clear), (3, long_line + "\n" + FREE_FORM)], "id long, text string")
    for r in redact_regex(df, "text", PinRegistry(REG)).collect():
        assert r["rx_text"] == pycheck.redact(r["text"], REG)[0]
