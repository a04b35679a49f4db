"""Span operators over tables (P2, P4, P6, P7, P8) against plain walks over sorted lists."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanmask.operators import span_tables as S

SPAN = "id long, start long, end long, prio int, label string, note string"


@pytest.fixture(autouse=True, params=[1 << 16, 7])
def bucket(request, monkeypatch):
    """Few positions a bucket, so that sweeps run over many."""
    monkeypatch.setattr(S, "BUCKET", request.param)


def _spans(seed, docs=12, n=25, reach=60):
    rng, out = random.Random(seed), []
    for d in range(docs):
        seen = set()
        for _ in range(rng.randint(0, n)):
            start, prio = rng.randrange(reach), rng.randrange(3)
            end = start + rng.randint(1, 12)
            if (start, end, prio) not in seen:
                seen.add((start, end, prio))
                out.append((None if d == 3 else d, start, end, prio, "ABC"[prio] * (prio + 1), "x"))
    return out


def _by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


def _resolved(rows):
    out = []
    for spans in _by_id(rows).values():
        last = -1
        for s in sorted(spans, key=lambda s: (s[1], s[1] - s[2], s[3])):
            if s[1] >= last:
                out.append(s)
                last = s[2]
    return out


def _ids(rows):
    """Null ids are no documents in joins; the operators leave them out of these tests."""
    return [r for r in rows if r[0] is not None]


@pytest.mark.parametrize("seed", range(3))
def test_resolution(spark, seed):
    rows = _ids(_spans(seed))
    got = S.resolve_table(spark.createDataFrame(rows, SPAN).repartition(4), "id")
    assert got.columns == ["id", "start", "end", "prio", "label", "note"]
    assert sorted(map(tuple, got.collect())) == sorted(_resolved(rows))


def test_resolution_of_long_chains(spark):
    # every span overlaps the next: one island, every second span is kept
    rows = [(1, 2 * i, 2 * i + 3, 0, "A", "x") for i in range(400)]
    got = S.resolve_table(spark.createDataFrame(rows, SPAN), "id")
    assert sorted(map(tuple, got.collect())) == _resolved(rows) and len(_resolved(rows)) == 200


def test_resolution_of_nothing(spark):
    assert S.resolve_table(spark.createDataFrame([], SPAN), "id").collect() == []


def test_places_of_placeholders(spark):
    rows = _resolved(_ids(_spans(5)))
    got = S.covered_table(spark.createDataFrame(rows, SPAN), "id")
    want = []
    for spans in _by_id(rows).values():
        shift = 0
        for s in sorted(spans, key=lambda s: s[1]):
            size = len(s[4]) + 2
            want.append((*s, s[1] + shift, s[1] + shift + size))
            shift += size - (s[2] - s[1])
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_gaps(spark, seed):
    ranges = [(r[0], r[1], r[2]) for r in _ids(_spans(seed, docs=8, n=6))]
    lengths = {d: 75 for d in range(10)} | {20: 0, 21: 5}
    got = S.uncovered_table(spark.createDataFrame(ranges, "id long, start long, end long"), spark.createDataFrame(list(lengths.items()), "id long, length long"), "id")
    want = []
    for d, n in lengths.items():
        cursor = 0
        for start, end in sorted((s, e) for i, s, e in ranges if i == d):
            if start > cursor:
                want.append((d, cursor, start))
            cursor = max(cursor, end)
        if n > cursor:
            want.append((d, cursor, n))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_merging(spark, seed):
    rows = _ids(_spans(seed))
    want = []
    for spans in _by_id(rows).values():
        last = None
        for s in sorted(spans, key=lambda s: (s[1], s[1] - s[2], s[3])):
            if last is None or s[1] >= last or s[2] > last:
                want.append(s)
                last = s[2]
    assert sorted(map(tuple, S.merge_table(spark.createDataFrame(rows, SPAN), "id", ["prio"]).collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_guard(spark, seed):
    rows, ranges = _ids(_spans(seed)), [(r[0], r[1], r[1] + (r[2] - r[1]) // 3) for r in _ids(_spans(seed + 50, n=5))]
    got = S.guard_table(spark.createDataFrame(rows, SPAN), spark.createDataFrame(ranges, "id long, start long, end long"), "id")
    want = [s for s in rows if not any(s[0] == d and s[2] > a and s[1] < b for d, a, b in ranges)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_spans_in_one_document_take_linear_time(spark, bucket, request):
    if S.BUCKET < 1000:
        pytest.skip("the size of the buckets in use")
    spent = []
    for n in (20_000, 200_000):
        spans = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 4).alias("end"), F.lit("x").alias("label"))
        ranges = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 5).alias("end"))
        t = time.perf_counter()
        # a span touches the range that starts in it; those of odd numbers end before the next
        assert S.guard_table(spans, ranges, "id").count() == n // 2
        spent.append(time.perf_counter() - t)
    assert spent[1] < 10 * spent[0] + 5
