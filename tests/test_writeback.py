"""Committed runs are seen whole, others not at all."""

import os

import pytest
from pyspark.sql import functions as F

from spanmask.plans.pipeline import redact
from spanmask.sources import writeback as W

ROWS = [(1, "mail a.b@mail.example.com", "x"), (2, "nothing", "y"), (3, None, "z"), (4, "host 10.0.0.7 is up", "w")]
MASKED = {1: "mail [EMAIL]", 2: "nothing", 3: None, 4: "host [IP] is up"}


@pytest.fixture()
def base(spark):
    return spark.createDataFrame(ROWS, "id long, text string, other string")


def _texts(base, path):
    return {r["id"]: r["text"] for r in W.written_back(base, path, "id").collect()}


def test_a_run_is_seen_after_its_commit_only(spark, base, scratch):
    path = os.path.join(scratch, "t")
    old = {r[0]: r[1] for r in ROWS}
    out = redact(base, disable_model=True)
    assert _texts(base, path) == old
    # killed between the steps, and half way through the second try
    n = W.stage(out, path, "id", "r1")
    assert n == 2 and _texts(base, path) == old
    os.remove(next(os.path.join(d, f) for d, _, fs in os.walk(os.path.join(path, "rows")) for f in fs if f.endswith(".parquet")))
    assert _texts(base, path) == old
    W.write_back(out, path, "id", "r1")
    assert _texts(base, path) == MASKED
    assert W.written_back(base, path, "id").columns == base.columns


def test_runs_are_safe_to_repeat_and_the_last_one_holds(spark, base, scratch):
    path = os.path.join(scratch, "t")
    out = redact(base, disable_model=True)
    W.write_back(out, path, "id", "r1")
    W.write_back(out.withColumn("redacted", F.lit("other")), path, "id", "r1")
    assert _texts(base, path) == MASKED and W.commits(spark, path).count() == 1
    W.write_back(out.where("id = 4").withColumn("redacted", F.lit("new")), path, "id", "r2")
    assert _texts(base, path) == MASKED | {4: "new"}
    assert [(r["run"], r["number"], r["rows"]) for r in W.commits(spark, path).orderBy("number").collect()] == [("r1", 0, 2), ("r2", 1, 1)]


def test_a_run_without_changes_commits(spark, base, scratch):
    path = os.path.join(scratch, "t")
    W.write_back(redact(base.where("id = 2"), disable_model=True), path, "id", "r1")
    assert _texts(base, path) == {r[0]: r[1] for r in ROWS}
    with pytest.raises(ValueError, match="run id"):
        W.write_back(redact(base, disable_model=True), path, "id", "../x")
