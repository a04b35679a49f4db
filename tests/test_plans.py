"""Plan shapes that matter at scale: layer 1 is map-only with a pruned scan, the
registry join is a broadcast semi join, aggregates pre-aggregate map-side, and
no expensive expression is duplicated by the optimizer."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanmask.functions.detectors import PinRegistry
from spanmask.plans import queries as Q
from spanmask.operators.entities import DictionaryScorer
from spanmask.plans.pipeline import redact


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layer_one_is_map_only_with_pruned_scan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = redact(docs.select("doc_id", "text"), "text", disable_model=True)  # a registry adds a subquery of its own
    plan = _plan(out.select("doc_id", "redacted"))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # each detector's regex appears once: no re-evaluation through inlined filters
    assert plan.count("regexp_replace") <= 13


def test_explode_does_not_duplicate_the_regex_chain(spark):
    plan = _plan(Q.q_uncovered_segments(spark, SF_SMALL))
    assert plan.count("regexp_replace") <= 13


def test_registry_join_is_broadcast_semi(spark):
    # the candidate side is never shuffled
    plan = _plan(Q.q_pin_semi_join(spark, SF_SMALL))
    assert "Broadcast" in plan and "LeftSemi" in plan


def test_table_registry_semi_join_is_broadcast_hash(spark):
    cands = spark.createDataFrame([(1, "560068"), (2, "199999")], "id long, pin string")
    reg = spark.createDataFrame([("560068",)], "pin string")
    plan = _plan(cands.join(F.broadcast(reg), "pin", "left_semi"))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_run_summary_partial_aggregation(spark):
    assert "partial_sum" in _plan(Q.q_run_summary(spark, SF_SMALL, "notes"))


@pytest.mark.parametrize("key", sorted(Q.registered()))
def test_one_regex_chain_per_plan(spark, key):
    """At most 13 regex replacements for layer 1 (each detector once, ADDRESS twice for its
    rescan), 3 for chunking, one for each of the scorer's tokens and stopwords."""
    plan = Q.registered()[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    persisted = plan.split("InMemoryRelation")[0]
    assert persisted.count("regexp_replace") <= 18
    if key in ("changed_only", "audit", "redact_regex", "pipeline_regex_only", "doc_hits"):
        assert plan.count("regexp_replace") <= 13
    if key in ("chunk_documents", "chunk_para_docs", "chunk_stats"):
        assert plan.count("regexp_replace") <= 3


def test_filters_stay_above_the_spans(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = redact(docs, "text", disable_model=True).where("regex_hits > 0")
    assert _plan(out).count("regexp_replace") <= 13


def test_no_job_runs_while_a_query_is_built(spark):
    """Only the reads of schemas, and of a dictionary whose size decides how it is matched; data
    is touched when the result is."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, build):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        build()
        spark.sparkContext.setJobGroup("", "")
        found = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"build-{name}")]
        return [j for j in found if j and len(j.stageIds) > 1]

    for key in ("pipeline_regex_only", "detect_postal", "redact_nonblank", "chunk_segments", "run_summary_join"):
        if key == "run_summary_join":
            terms = Q.entity_terms(spark, SF_SMALL)
            assert not jobs(key, lambda: redact(Q.documents(spark, SF_SMALL), "text", scorer=DictionaryScorer(terms, automaton_chars=0)))  # noqa: B023
        else:
            assert not jobs(key, lambda: Q.registered()[key](spark, SF_SMALL)), key  # noqa: B023
    # the dictionary is read once for all queries of a scorer
    scorer = DictionaryScorer(Q.entity_terms(spark, SF_SMALL))
    redact(Q.documents(spark, SF_SMALL), "text", scorer=scorer)
    assert not jobs("again", lambda: redact(Q.documents(spark, SF_SMALL), "text", scorer=scorer))
