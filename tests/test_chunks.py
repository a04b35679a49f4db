"""Chunking: worked cases for each rule and trap, and invariants on the supplied texts."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanmask.functions.chunks import chunk_ranges, hard_windows
from spanmask.plans.queries import para_docs

SENTENCES = "One two. Three four. Five six. Seven."

# name -> (text, size, overlap, chunks)
CASES = {
    "empty": ("", 20, 5, []),
    "fits": ("exactly twenty chars", 20, 5, [(0, 20)]),
    "hard": ("a" * 50, 20, 5, [(0, 20), (15, 35), (30, 50)]),
    "hard with a short rest": ("a" * 36, 20, 5, [(0, 20), (15, 35), (30, 36)]),
    "hard, ends on a window": ("a" * 35, 20, 5, [(0, 20), (15, 35)]),
    "overlap over size": ("a" * 23, 20, 60, [(0, 20), (1, 21), (2, 22), (3, 23)]),
    "paragraphs packed": ("aaaa\n\nbbbb\n\ncccc\n\ndddddddd", 20, 5, [(0, 18), (18, 26)]),
    "oversize paragraph with its break is cut hard": ("A b. " * 6 + "\n\ntail.", 20, 5, [(0, 20), (15, 32), (32, 37)]),
    "oversize tail goes by sentences": ("ab\n\n" + SENTENCES, 20, 5, [(0, 4), (4, 13), (13, 25), (25, 41)]),
    "sentences": (SENTENCES, 20, 5, [(0, 9), (9, 21), (21, 37)]),
    "oversize sentence is cut hard": ("Hi. " + "y" * 30 + ". Bye.", 20, 5, [(0, 4), (4, 24), (19, 36), (36, 40)]),
    "break only at the end": ("x" * 30 + "\n\n", 20, 5, [(0, 20), (15, 32)]),
    "one sentence": ("z" * 25 + ".", 20, 5, [(0, 20), (15, 26)]),
    "quote after the stop": ('He said "no." Then he left, and so on.', 20, 5, [(0, 14), (14, 34), (29, 38)]),
    "sentence ends over a break do not count": ("a b. c d. e f.\n\n" * 2, 20, 5, [(0, 16), (16, 32)]),
}


def _ranges(spark, df, size, overlap):
    text = F.coalesce("text", F.lit(""))
    return [(r["text"], [tuple(x) for x in r["c"]]) for r in df.select("text", chunk_ranges(text, size, overlap).alias("c")).collect()]


@pytest.mark.parametrize("name", list(CASES))
def test_worked_cases(spark, name):
    text, size, overlap, want = CASES[name]
    df = spark.createDataFrame([(text,)], "text string")
    assert _ranges(spark, df, size, overlap)[0][1] == want


@pytest.mark.parametrize("size,overlap", [(1600, 200), (200, 50), (40, 60)])
def test_invariants(spark, size, overlap):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, para_docs(spark, SF_SMALL)):
        for text, got in _ranges(spark, df, size, overlap):
            assert all(0 <= s < e <= s + size for s, e in got)
            assert got == sorted(got)
            # every character is in a chunk
            at = 0
            for s, e in got:
                assert s <= at
                at = max(at, e)
            assert at == len(text)
            # neighbours that would fit together are one chunk, unless a hard window is among them
            hard = {i for i in range(len(got)) for j in (i - 1, i + 1) if 0 <= j < len(got) and got[min(i, j)][1] > got[max(i, j)][0]}
            for i in range(len(got) - 1):
                if not {i, i + 1} & hard:
                    assert got[i][1] == got[i + 1][0] and (got[i + 1][1] - got[i][0] > size or "\n\n" in text)


def test_long_texts_take_time_by_length(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("A short sentence. " * 120 + "\n\n") * n], "string").toDF("text")
        t = time.perf_counter()
        got = _ranges(spark, df, 1600, 200)[0][1]
        assert got[-1][1] == 2162 * n
        return time.perf_counter() - t

    seconds(2)
    small, large = seconds(200), seconds(800)
    assert large < 8 * small + 2, (small, large)


def test_hard_windows(spark):
    cases = {(0, 10, 2): [], (5, 10, 2): [(0, 5)], (10, 10, 2): [(0, 10)], (11, 10, 2): [(0, 10), (8, 11)], (12, 10, 20): [(0, 10), (1, 11), (2, 12)]}
    for (n, size, overlap), want in cases.items():
        r = spark.range(1).select(hard_windows(F.lit(0), F.lit(n), size, overlap).alias("w")).first()["w"]
        assert [tuple(x) for x in r] == want
