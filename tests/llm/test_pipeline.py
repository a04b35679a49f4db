"""The pipeline's stages, each on its own input, against brute force; odd and empty inputs."""

import os
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
from spanmask.llm import mixing, quality_classifier, queries  # noqa: E402
from test_operators import SCHEMA, WORD, _odd_rows, _packed, brute_components, brute_removed  # noqa: E402
from tools.compare import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, as run() chains them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    base = tmp_path_factory.mktemp("pipeline")
    for name, stage in P.STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_the_stages_are_the_stated_ones(stages):
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    assert all(out.columns == COLUMNS for out in [o for _, o in stages.values()][:-1])
    assert P.ORACLE_SQL is None


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    docs, out = stages["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in scored.where("score >= 0.3").select("doc_id").collect()}
    good = labels.where("quality = 1")
    assert docs.join(good, "doc_id").count() * 0.98 <= out.join(good, "doc_id").count()


def test_one_document_of_each_component(stages):
    docs, out = stages["simhash_near_dedup"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(want)
    assert out.exceptAll(docs).count() == 0


def test_passages_that_repeat_are_gone(stages):
    import hashlib

    docs, out = stages["substring_dedup"]
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for (i, text), (_, removed, sha) in zip(rows, brute_removed([t for _, t in rows], 35), strict=True):
        if removed:
            assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == sha
        else:
            assert got[i]["text"] == text
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_sources_are_taken_to_their_targets(stages):
    docs, out = stages["source_mixing"]
    goal = {r["source"]: r["target"] for r in mixing.targets(docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))).collect()}
    words = Counter()
    for r in out.select("source", "text").collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())


def test_pieces_are_packed(stages):
    docs, out = stages["best_fit_packing"]
    n, least = _packed(docs, 2048)
    assert n <= least * 1.01 + 1
    assert out.select("sequence_id").distinct().count() == n


@pytest.mark.parametrize("odd", [True, False])
def test_odd_and_empty_inputs(spark, odd):
    docs = spark.createDataFrame(_odd_rows() if odd else [], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = out
    assert bool(out.count()) == odd


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[key](spark, SF)
    rows, res = [tuple(r) for r in df.collect()], con.sql(queries.oracle_sql()[key])
    assert sorted(df.columns) == sorted(res.columns)
    assert digest(rows, df.columns) == digest(res.fetchall(), res.columns)
