"""SQL functions: equal to the Column expressions on texts of all kinds, and their edges."""

import random

import pytest
from pyspark.sql import functions as F

import pycheck
from conftest import SF_SMALL
from spanmask import sql
from spanmask.functions import chunks, rowwise
from spanmask.functions.detectors import PinRegistry
from spanmask.operators.regex_layer import redact_regex
from test_detectors_golden import CASES

PINS = ["110001", "560068"]


@pytest.fixture(scope="module")
def functions(spark):
    sql.register(spark, PinRegistry(PINS))


def test_golden_cases(spark, functions):
    df = spark.createDataFrame([(name, case[0]) for name, case in CASES.items()], "name string, text string")
    rows = spark.sql("select name, redact_counts(text) as counts, redact_text(text) as out from {df}", df=df).collect()
    want = {name: pycheck.redact(case[0], frozenset(PINS)) for name, case in CASES.items()}
    for r in rows:
        assert dict(r["counts"]) == want[r["name"]][2] and r["out"] == want[r["name"]][0], r["name"]


def test_functions_equal_columns(spark, functions):
    rng = random.Random(3)
    parts = ["a.b@mail.example.com", "+91 98765 43210", "ABCDE1234F", "2345 6789 0123", "x@okbank", "10.0.0.7", "sk_" + "Ab1" * 9, "4111-1111-1111-1111", "123-45-6789", "560068", "999999", "12345", " ", "\n", "\n\n", ", ", "é", "١" * 5,
             "Flat 12B, Rose Court,\n4th Cross, Lakeside,\nBengaluru 560068", "State: Karnataka", "Floor No.: 3\n", "word", "﷐", "\U0001f600"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) + rng.choice(("", " ", "\n")) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for name in ("documents", "pages"):
        column = {"documents": "text", "pages": "html"}[name]
        table = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        df = df.unionByName(table.select(F.monotonically_increasing_id().cast("int").alias("id"), F.col(column).alias("text")))
    both = redact_regex(df, "text", PinRegistry(PINS)).select("rx_text", "rx_spans", "rx_counts", F.call_function("redact_text", "text").alias("out"), F.call_function("redact_spans", "text").alias("spans"), F.call_function("redact_counts", "text").alias("counts"))
    for r in both.collect():
        assert r["out"] == r["rx_text"] and dict(r["counts"]) == dict(r["rx_counts"])
        assert [(s["start"], s["end"], s["label"]) for s in r["spans"]] == [(s["start"], s["end"], s["label"]) for s in r["rx_spans"]]


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (37, 0), (10, 9)])
def test_chunks_equal_columns(spark, functions, size, overlap):
    rng = random.Random(size)
    parts = ["One two. ", "Three! ", "'quoted.' ", "\n\n", "\n\n\n", "a" * 25, "word ", "é? ", ". "]
    texts = [None, "", "x"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = spark.sql(f"select * from chunk_text(table({{df}}), {size}, {overlap})", df=df)
    assert got.columns == ["id", "chunk_idx", "start", "end"]
    want = df.select("id", F.posexplode(chunks.chunk_ranges(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk_idx", "r")).select("id", "chunk_idx", "r.start", "r.end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunk_text_keeps_other_columns_and_checks_its_arguments(spark, functions):
    df = spark.createDataFrame([(1, "abc", "de", 7)], "id int, text string, lang string, start int")
    row = spark.sql("select * from chunk_text(table({df}), 10, 2)", df=df).first()
    assert row.asDict() == {"id": 1, "lang": "de", "chunk_idx": 0, "start": 0, "end": 3}
    for call in ("table({df}), 10, 10", "table({df}), 0, 0", "table(select id from {df}), 10, 2"):
        with pytest.raises(Exception, match="chunk_text needs"):
            spark.sql(f"select * from chunk_text({call})", df=df).collect()


def test_pins_fit_a_bitmap():
    known = rowwise.Pins(iter([100000, 560068, 899999]))
    assert [p in known for p in ("100000", "560068", "899999", "560069", "099999", "900000", "56006", "١" * 6)] == [True] * 3 + [False] * 5


def test_no_registry_lets_no_pin_pass(spark):
    sql.register(spark)
    df = spark.createDataFrame([("pin 560068 zip 12345",)], "text string")
    assert spark.sql("select redact_text(text) as t from {df}", df=df).first()["t"] == "pin 560068 zip [POSTAL_CODE]"


def test_addresses_and_long_texts_take_linear_time():
    import time

    block = "Flat 12B, Rose Court,\n4th Cross, Lakeside,\nBengaluru 560068\n"
    for unit in (block, "Floor No.: 3\nFlat 1\n", "a@b ", "1 2 3 4 ", "x" * 50 + "\n"):
        t = time.perf_counter()
        rowwise.masked(unit * 5000, rowwise.Pins(iter([560068])))
        assert time.perf_counter() - t < 10, unit
