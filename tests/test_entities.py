"""Entity layer: failure isolation (E3), load once (E4), merge-then-mask trap,
dictionary scorer boundaries, threshold/stopword/label filters (V4, V5, E2)."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmask.config import RedactConfig
from spanmask.operators.entities import DictionaryScorer, Scorer
from spanmask.plans.pipeline import redact


class FixedScorer(Scorer):
    """Returns the given hits wherever their text occurs in a chunk; raises on 'boom'."""

    name = "fixed"

    def __init__(self, hits, log_dir=None):
        self.hits = hits
        self.log_dir = log_dir

    def load(self):
        if self.log_dir:
            with open(os.path.join(self.log_dir, f"load-{os.getpid()}"), "a") as fh:
                fh.write("x\n")
        return "model"

    def score(self, model, text, labels, threshold):
        if "boom" in text:
            raise RuntimeError("scorer failed")
        out = []
        for h in self.hits:
            at = text.find(h["text"])
            if at >= 0:
                out.append(dict(h, start=at, end=at + len(h["text"])))
        return out


@pytest.fixture(autouse=True)
def _ship_module(spark):
    # the test scorers live in this module: make it importable on the workers
    spark.sparkContext.addPyFile(__file__)


def test_failure_isolation(spark):
    hits = [{"label": "person", "start": 0, "end": 5, "text": "Alice", "confidence": 0.9}]
    df = spark.createDataFrame([(1, "Alice went home."), (2, "Alice said boom.")], "id long, text string")
    rows = {r["id"]: r for r in redact(df, "text", scorer=FixedScorer(hits)).collect()}
    assert rows[1]["redacted"] == "[PERSON] went home." and rows[1]["model_errors"] == []
    assert rows[2]["redacted"] == "Alice said boom." and rows[2]["model_errors"] == ["RuntimeError"]


def test_merge_then_mask_leaves_tail(spark):
    # A(0,5), B(3,9), C(6,8): merge keeps A and B, masking skips B -> 5..9 stays readable
    text = "abcdefghijkl"
    hits = [
        {"label": "person", "start": 0, "end": 5, "text": "abcde", "confidence": 0.9},
        {"label": "person", "start": 3, "end": 9, "text": "defghi", "confidence": 0.9},
        {"label": "person", "start": 6, "end": 8, "text": "gh", "confidence": 0.9},
    ]
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = redact(df, "text", scorer=FixedScorer(hits)).first()
    assert r["redacted"] == "[PERSON]fghijkl"
    assert dict(r["model_counts"]) == {"person": 1}


def test_filters_threshold_stopwords_labels(spark):
    hits = [
        {"label": "person", "start": 0, "end": 3, "text": "Bob", "confidence": 0.74},
        {"label": "person", "start": 4, "end": 7, "text": "Pin", "confidence": 0.99},
        {"label": "email", "start": 8, "end": 11, "text": "Ann", "confidence": 0.99},
        {"label": "city", "start": 12, "end": 15, "text": "Goa", "confidence": 0.75},
    ]
    df = spark.createDataFrame([(1, "Bob Pin Ann Goa")], "id long, text string")
    r = redact(df, "text", scorer=FixedScorer(hits)).first()
    assert r["redacted"] == "Bob Pin Ann [CITY]"


def test_model_sees_only_uncovered_text(spark):
    hits = [{"label": "person", "start": 0, "end": 4, "text": "Mira", "confidence": 0.9}]
    df = spark.createDataFrame([(1, "Mira mira@mail.example.com Mira")], "id long, text string")
    r = redact(df, "text", scorer=FixedScorer(hits)).first()
    assert r["redacted"] == "[PERSON] [EMAIL] [PERSON]"
    assert r["num_chunks"] == 2


def test_load_once_per_worker(spark, scratch):
    hits = [{"label": "person", "start": 0, "end": 5, "text": "Alice", "confidence": 0.9}]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.range(400).select(F.col("id"), F.concat(F.lit("Alice and more "), "id").alias("text")).repartition(2)
        n = redact(df, "text", scorer=FixedScorer(hits, scratch)).where(F.col("model_hits") == 1).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert n == 400
    loads = sum(len(open(os.path.join(scratch, f)).readlines()) for f in os.listdir(scratch))
    assert 1 <= loads <= len(os.listdir(scratch)) <= 8  # once per Python worker, not per batch


def test_dictionary_scorer_word_boundaries(spark):
    terms = spark.createDataFrame([("ASIA", "location", 0.9), ("MIDDLE EAST", "location", 0.9),
                                   ("MIDDLE", "city", 0.9)], "term string, label string, confidence double")
    scorer = DictionaryScorer.from_table(spark, terms)
    df = spark.createDataFrame([(1, "ASIAN ASIA, MIDDLE EAST and MIDDLE.")], "id long, text string")
    r = redact(df, "text", scorer=scorer, config=RedactConfig()).first()
    assert r["redacted"] == "ASIAN [LOCATION], [LOCATION] and [CITY]."


def test_stopwords_with_any_space_around_them(spark):
    class Spaced(Scorer):
        def score(self, model, text, labels, threshold):
            return [{"label": "person", "start": 0, "end": 6, "text": t, "confidence": 0.9} for t in [{"n": "client\n", "t": "\tPin ", "u": "\u00a0Office\u2003", "x": "\u00a0ann"}[text[-1]]]]

    df = spark.createDataFrame([(c, "client " + c) for c in "ntux"], "id string, text string")
    rows = {r["id"]: r["redacted"] for r in redact(df, scorer=Spaced()).collect()}
    assert rows == {"n": "client n", "t": "client t", "u": "client u", "x": "[PERSON] x"}


def test_a_hit_without_text_is_kept(spark):
    class NoText(Scorer):
        def score(self, model, text, labels, threshold):
            return [{"label": "person", "start": 0, "end": 6, "confidence": 0.9}]

    df = spark.createDataFrame([("client here",)], "text string")
    assert redact(df, scorer=NoText()).first()["redacted"] == "[PERSON] here"


def test_batches_are_scored_together_and_fail_alone(spark):
    class Batched(Scorer):
        batch_size = 7

        def score_batch(self, model, texts, labels, threshold):
            assert 0 < len(texts) <= 7
            return [ValueError("no") if "3" in t else [{"label": "city", "start": 0, "end": 1, "text": t[0], "confidence": 1.0}] for t in texts]

    df = spark.range(40).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    for r in redact(df, scorer=Batched()).collect():
        bad = "3" in str(r["id"])
        assert r["model_errors"] == (["ValueError"] if bad else []) and r["model_hits"] == (0 if bad else 1) and r["scored_chunks"] == 1


def test_equal_documents_are_scored_once(spark):
    hits = [{"label": "person", "start": 0, "end": 5, "text": "Alice", "confidence": 0.9}]
    df = spark.createDataFrame([(i, "Alice is here") for i in range(50)], "id long, text string")
    rows = redact(df, scorer=FixedScorer(hits)).collect()
    assert len(rows) == 50 and all(r["redacted"] == "[PERSON] is here" and r["scored_chunks"] == 1 for r in rows)


def test_dictionary_terms_of_all_shapes(spark):
    terms = spark.createDataFrame([("a-b", "city", 0.9), ("$x", "city", 0.9), ("été", "city", 0.9), ("end.", "city", 0.9), (" lead", "city", 0.9), ("", "city", 0.9), (None, "city", 0.9), ("low", "city", 0.1), ("other", "nolabel", 0.9)], "term string, label string, confidence double")
    text = "a-b a-bc xa-b $x y$x $xy été étés end. end.x lead low other"
    df = spark.createDataFrame([(text,)], "text string")
    r = redact(df, scorer=DictionaryScorer(terms)).first()
    assert r["redacted"] == "[CITY] a-bc xa-b [CITY] y[CITY] $xy [CITY] étés [CITY] [CITY]x lead low other"


def test_guard_of_touching_and_empty_ranges(spark):
    from spanmask.operators.entities import ESPAN_ARRAY, guard

    spans = [(0, 4), (4, 6), (6, 9), (8, 12), (12, 13), (14, 20)]
    covered = [(4, 6), (10, 12), (15, 16)]
    want = [s for s in spans if not any(s[1] > c[0] and s[0] < c[1] for c in covered)]
    df = spark.createDataFrame([([(a, a - b, 0, 0, 0, b, "x") for a, b in spans], covered)], T.StructType([T.StructField("s", ESPAN_ARRAY), T.StructField("c", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]))
    assert [(x["start"], x["end"]) for x in df.select(guard(F.col("s"), F.col("c")).alias("g")).first()["g"]] == want


def test_a_batch_that_raises_loses_only_the_text_at_fault(spark):
    class Strict(Scorer):
        batch_size = 64

        def score_batch(self, model, texts, labels, threshold):
            if any("bad" in t for t in texts):
                raise KeyError("bad")
            return [[{"label": "city", "start": 0, "end": 1, "text": t[0], "confidence": 1.0}] for t in texts]

    df = spark.range(64).coalesce(1).select("id", F.concat(F.lit("x"), F.col("id").cast("string"), F.when(F.col("id").isin(5, 40), " bad").otherwise("")).alias("text"))
    rows = {r["id"]: r for r in redact(df, scorer=Strict()).collect()}
    assert [i for i, r in rows.items() if r["model_errors"]] == [5, 40]
    assert all(r["model_hits"] == (0 if i in (5, 40) else 1) for i, r in rows.items())


def test_score_apart_halves_and_checks_lengths():
    from spanmask.operators.entities import score_apart

    calls = []

    class Model(Scorer):
        def score_batch(self, model, texts, labels, threshold):
            calls.append(len(texts))
            return [[]] if "short" in texts and len(texts) > 1 else [[] for _ in texts]

    assert score_apart(Model(), None, ["a", "short", "b", "c"], [], 0.5) == [[], [], [], []]
    assert calls == [4, 2, 1, 1, 2]


SHAPES = [("a-b", "city", 0.9), ("$x", "city", 0.9), ("été", "city", 0.9), ("end.", "city", 0.9), (" lead", "city", 0.9), ("", "city", 0.9), (None, "city", 0.9),
          ("low", "city", 0.1), ("other", "nolabel", 0.9), ("aa", "person", 0.8), ("aa aa", "person", 0.9), ("aa", "city", 0.8), ("a", "city", 0.95), ("\U0001f600", "city", 0.9)]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_and_join_give_the_same_hits(spark, seed):
    import random

    from spanmask.functions.patterns import ENTITY_LABELS

    rng = random.Random(seed)
    terms = spark.createDataFrame(SHAPES, "term string, label string, confidence double")
    parts = ["a", "aa", "-", "b", " ", "$", "x", "été", "e", "end.", ".", " lead", "low", "_", "7", "\n", "\u00a0", "\U0001f600", "other"]
    rows = [(i.to_bytes(2), 0, 3, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    chunks = spark.createDataFrame([r for r in rows if r[3].strip()], "key binary, chunk_idx int, cstart int, text string")
    both = [DictionaryScorer(terms, automaton_chars=n).scored(chunks, ENTITY_LABELS, 0.75).collect() for n in (4_000_000, 0)]
    assert sorted(both[0], key=str) == sorted(both[1], key=str) and any(r["label"] for r in both[0])


def test_large_dictionaries_are_joined(spark):
    terms = spark.range(300).select(F.concat(F.lit("name"), "id").alias("term"), F.lit("person").alias("label"), F.lit(0.9).alias("confidence"))
    df = spark.createDataFrame([(1, "name7 and name299, name300"), (2, "none")], "id long, text string")
    scorer = DictionaryScorer(terms, automaton_chars=100)
    out = redact(df, scorer=scorer)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and scorer.automaton(["person"], 0.75) is None
    assert {r["id"]: r["redacted"] for r in out.collect()} == {1: "[PERSON] and [PERSON], name300", 2: "none"}


def test_small_dictionaries_need_no_shuffle_and_persist_nothing(spark):
    terms = spark.createDataFrame([("Alice", "person", 0.9)], "term string, label string, confidence double")
    out = redact(spark.createDataFrame([(1, "Alice, Bob"), (2, None), (3, " ")], "id long, text string"), scorer=DictionaryScorer(terms))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "InMemoryTableScan" not in plan and out.staged is None
    rows = {r["id"]: r for r in out.collect()}
    assert (rows[1]["redacted"], rows[1]["scored_chunks"], rows[1]["model_hits"]) == ("[PERSON], Bob", 1, 1)
    assert (rows[2]["redacted"], rows[2]["scored_chunks"], rows[3]["redacted"], rows[3]["mode"]) == ("", 0, " ", "blank")


def test_an_empty_dictionary_matches_nothing(spark):
    terms = spark.createDataFrame([], "term string, label string, confidence double")
    df = spark.createDataFrame([(1, "Alice")], "id long, text string")
    for n in (0, 100):
        assert redact(df, scorer=DictionaryScorer(terms, automaton_chars=n)).first()["redacted"] == "Alice"


def test_release_frees_what_chunk_rows_need(spark):
    from spanmask.plans.pipeline_full import release

    df = spark.createDataFrame([(1, "Alice went home.")], "id long, text string")
    mine = spark.range(7).cache()
    mine.count()
    out = redact(df, scorer=FixedScorer([{"label": "person", "start": 0, "end": 5, "text": "Alice", "confidence": 0.9}]))
    out.collect()
    assert out.staged.storageLevel.useDisk
    release(out)
    assert not out.staged.storageLevel.useDisk and mine.storageLevel.useMemory
    mine.unpersist()


def test_hits_in_the_row_become_arrow_in_small_parts():
    import pyarrow as pa

    from spanmask.operators import entities as E

    def hits(i):
        return [(i, 3, n, 0, n, n + 2, "person", "ab", 0.5) for n in range(i % 200)]

    held = []
    parts = E._packed_rows((i, i % 7, held.append(i) or hits(i)) for i in range(2000))
    first = next(parts)
    assert len(first) == len(held) < 200  # what has been read is Arrow before more is read
    got = pa.concat_arrays([first, *parts])
    names = [f.name for f in E._HIT_ARROW]
    want = [{"chunks": i, "scored": i % 7, "hits": [dict(zip(names, h, strict=True)) for h in hits(i)]} for i in range(2000)]
    assert got.type == E._ROW_ARROW and got.to_pylist() == want
    assert pa.concat_arrays(list(E._packed_rows([]))).to_pylist() == []
    assert all(len(p) <= 512 for p in E._packed_rows((1, 1, []) for _ in range(2000)))


def test_an_automaton_travels_packed():
    import pickle

    from spanmask.functions.patterns import ENTITY_LABELS
    from spanmask.operators.entities import AutomatonScorer

    entries = [(f"term{i}", ("person", "city", "organization")[i % 3], 0.6 + i % 5 / 10) for i in range(3000)] + [("term7", "person", 0.9), ("term7", "city", 0.7)]
    scorer = AutomatonScorer(entries)
    sent = pickle.loads(pickle.dumps(scorer))
    assert isinstance(sent.entries, bytes) and len(sent.entries) < 20 * len(entries)
    again = pickle.loads(pickle.dumps(sent))
    found = [s.score(s.load(), "a term7, term2999 term30000 term12", ENTITY_LABELS, 0.0) for s in (scorer, sent, again)]
    assert found[0] == found[1] == found[2] and [(h["text"], h["label"], h["confidence"]) for h in found[0]] == [
        ("term7", "city", 0.7), ("term7", "city", 0.8), ("term7", "person", 0.9), ("term2999", "organization", 1.0), ("term12", "person", 0.8)]
    assert AutomatonScorer([]).score(AutomatonScorer([]).load(), "x", ENTITY_LABELS, 0.0) == []


def test_the_terms_are_made_once(spark):
    """Counting and collecting a dictionary makes each term once, however many filters read it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def term(i):
        made.add(1)
        return f"term{i}"

    terms = spark.range(50).select(term("id").alias("term"), F.lit("person").alias("label"), F.lit(0.9).alias("confidence"))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    assert len(DictionaryScorer(terms).automaton(["person"], 0.75).load()) == 50 and made.value == 50
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
