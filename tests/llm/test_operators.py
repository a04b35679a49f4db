"""Operators on Spark against brute force, with odd rows: nulls, empty and very long texts,
ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmask.llm import html_extract, language_id, mixing, packing, quality_classifier, quality_rules, queries, simhash, substring_dedup, url_filter, vector_search
from spanmask.llm.components import components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row int, id string, n_words string, taken int, label int, component long"


def _rows(texts, lang="en"):
    return [(i, t, lang, f"s{i % 3}", len(t or ""), 0.5, "k", 1, "x", "n", 3, 0, 7) for i, t in enumerate(texts)]


def _odd_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    texts = [None, "", " \n\t ", "one", "two words", prose(300), prose(40) + "\n" + shared + " " + prose(30), shared + " tail", "head " + shared, prose(34), "a " * 90, "a " * 34, prose(50_000)]
    near = prose(400).split()
    texts += [" ".join(near), " ".join(near[:-1] + ["other"]), " ".join(near).upper(), "Ünï cödé, täxt " * 3]
    rows = _rows(texts)
    rows += [rows[5], rows[5], rows[0], rows[1], (None, "no id here", None, None, None, None, None, None, None, None, None, None, None), (None, shared, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- substring dedup ------------------------------------------------------------------------


def brute_removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 6, 1])
def test_substring_dedup_against_brute_force(odd, window):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_removed([t for _, t in rows], window), strict=True))
    out = substring_dedup.remove_repeats(odd, "text", window)
    assert [c for c in odd.columns if c != "n_words"] == out.columns[: len(odd.columns) - 1]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["h"]) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect())
    assert got == want


def test_substring_dedup_of_random_small_alphabets(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = substring_dedup.remove_repeats(df, "text", 9).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute_removed(texts, 9)


# -- SimHash --------------------------------------------------------------------------------


def brute_components(rows, radius=3):
    from test_units import brute_fingerprint

    fp = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fp))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for (i, _), f in zip(rows, fp, strict=True):
        r = find(f)
        low[r] = i if low[r] is None else low[r] if i is None else min(low[r], i)
    return sorted((str(i), f"{f:016x}", str(low[find(f)])) for (i, _), f in zip(rows, fp, strict=True))


@pytest.fixture(autouse=True, scope="module")
def _path():
    import os
    import sys

    sys.path.insert(0, os.path.dirname(__file__))


def test_simhash_against_brute_force(odd, docs):
    some = docs.select("doc_id", F.substring("text", 1, 400).alias("text")).limit(400)
    for df in (odd.select("doc_id", "text").where("length(text) < 9000 or text is null"), some):
        rows = [tuple(r) for r in df.collect()]
        got = simhash.near_duplicates(df, "text", "doc_id").collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == brute_components(rows)


def test_links_by_small_tiles_are_the_same(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300)
    fps = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 63, 300)), base ^ 7]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = [{r["u"]: r["v"] for r in components(simhash.links(df, 3, tile)).collect()} for tile in (1 << 16, 16)]
    assert roots[0] == roots[1] and len(roots[0]) >= 600 * 0.9


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "u long, v long")
    assert {r["u"]: r["v"] for r in components(edges).collect()} == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_one_row_of_each_component_stays(odd):
    kept = simhash.one_of_each(odd, "text", "doc_id")
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 9000]
    want = {c for _, _, c in brute_components(rows)}
    assert len(want) == sum(1 for r in kept.select("text").collect() if len(r["text"] or "") < 9000)


# -- packing --------------------------------------------------------------------------------


def _packed(df, capacity):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(df, path, capacity=capacity).collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at : at + capacity], "<u4")
            want.append((str(r["doc_id"]), n, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [w[3] for w in want]
    return len(sequences), max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


@pytest.mark.parametrize("capacity", [2048, 37])
def test_packing_against_the_tokenizer(odd, docs, capacity):
    extra = docs.sparkSession.createDataFrame([(1, "I'm <|endoftext|> e\u0301\u00a0x\u2003y\u0085z\x1cq İ Σας 12 3ab!! ..."), (2, "<|startoftext|>")], "doc_id long, text string")
    for df in (odd.unionByName(extra, allowMissingColumns=True), docs):
        n, least = _packed(df, capacity)
        assert n <= least * 1.01 + 1


def test_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANKED", 10)
    df = spark.createDataFrame([(i, "same text here") for i in range(300)], "doc_id long, text string")
    n, least = _packed(df, 64)
    assert n == least


def test_many_pieces_of_every_length(spark):
    """Each of 2,048 lengths has more pieces than one part ranks."""
    n = 501
    found = spark.range(2048 * n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 2048 + 1).alias("length"), F.col("id").alias("ids_crc32"))
    out = packing.pack(found)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 20
    got = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count(F.lit(1)).alias("rows"))
    bad = got.where("n > 2048 or end <> n or places <> rows").count()
    assert bad == 0 and out.count() == 2048 * n



# -- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, share * sum(sizes.values()), list(names)
    while free:  # what exceeds a limit is dealt out again
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            target.update({s: rest * w[s] / total for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free = [s for s in free if s not in over]
    return target


def test_mixing_meets_its_targets(odd, docs):
    for df, slots in ((odd, 64), (docs, 1 << 10), (docs.where("source in ('src1', 'src2') or doc_id = 3"), 1 << 10)):
        got = mixing.mix(df, slots=slots).collect()
        rows = df.select("doc_id", "text", "source").collect()
        assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(r["doc_id"]), len(WORD.findall(r["text"] or "")), str(r["source"])) for r in rows)
        size, taken = Counter(), Counter()
        for r in got:
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        want = brute_targets(dict(size))
        for r in got:
            assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        for s, t in want.items():
            assert abs(taken[s] - t) <= 1


def test_mixing_is_repeatable_and_scheduled_evenly(docs):
    a, b = (sorted(map(tuple, mixing.mix(d, slots=1 << 10).collect())) for d in (docs, docs.repartition(13)))
    assert a == b
    goal = mixing.targets(docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size")))
    slots = mixing.schedule(goal, 1 << 10).collect()
    want = {r["source"]: r["target"] for r in goal.collect()}
    for upto in (100, 1 << 10):
        n = Counter(r["source"] for r in slots if r["slot"] < upto)
        assert all(abs(n[s] - upto * t / sum(want.values())) <= 5 for s, t in want.items())
    first = defaultdict(list)
    for r in slots:
        first[r["source"]].append((r["slot"], r["rank"]))
    assert all([k for _, k in sorted(x)] == list(range(len(x))) for x in first.values())


def test_mixed_rows_hold_the_words_taken(odd, docs):
    for df in (odd, docs):
        taken = Counter()
        for r in mixing.mix(df, slots=1 << 10).collect():
            taken[r["source"]] += r["taken"]
        out = mixing.mixed_rows(df, slots=1 << 10)
        assert out.columns == df.columns
        words = Counter()
        for r in out.select("source", "text").collect():
            words[r["source"]] += len(WORD.findall(r["text"]))
        assert all(abs(words[s] - n) <= 1 for s, n in taken.items())


def test_only_slots_take_words(docs, monkeypatch):
    dealt = mixing.schedule
    whole = mixing.mix(docs, slots=1 << 10).agg(F.sum("taken")).first()[0]
    monkeypatch.setattr(mixing, "schedule", lambda goal, slots: dealt(goal, slots).where("rank < 3"))
    three = mixing.mix(docs, slots=1 << 10).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    block = math.ceil(whole / (1 << 10)) + 1
    assert all(0 < r["n"] <= 3 * block for r in three)


def test_every_needed_slot_is_dealt():
    for m in [*range(1, 400), 4_001, 65_536, 70_003]:
        x = np.sort(((np.arange(2 * m + 16) + 0.5) * mixing.GOLDEN) % 1.0)
        assert max(np.diff(x).max(), x[0], 1 - x[-1]) < 1 / m


def test_slots_are_those_of_the_blocks_taken(docs):
    """first_slot and second_slot by walking the schedule slot by slot."""
    slots = 1 << 10
    rows = mixing.mix(docs, slots=slots).collect()
    goal = {r["source"]: (round(r["target"]), r["source_size"]) for r in rows}
    block = max(1, math.ceil(1.5 * sum(n for _, n in goal.values()) / slots))
    names, n_blocks = sorted(goal), {s: -(-n // block) for s, (_, n) in goal.items()}
    need = {s: -(-t // block) if t <= n else n_blocks[s] + -(-(t - n) // block) for s, (t, n) in goal.items()}
    total, ranks, slot_of = sum(need.values()), Counter(), {}
    for slot in range(2 * total + 16):
        x, low = (slot + 0.5) * mixing.GOLDEN % 1.0, 0
        for s in names:
            if low / total <= x < (low + need[s]) / total:
                slot_of[s, ranks[s]] = slot
                ranks[s] += 1
            low += need[s]
    for r in rows:
        (t, n), s, b = goal[r["source"]], r["source"], r["start"] // block
        assert r["first_slot"] == (slot_of[s, b] if r["size"] and r["start"] < t else None)
        assert r["second_slot"] == (slot_of[s, n_blocks[s] + b] if r["size"] and r["start"] < t - n else None)


@pytest.mark.parametrize("n", [1, 6, 20, 100])
def test_sources_of_equal_sizes(spark, n):
    words = " ".join("w" * 10)
    df = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.lit(words).alias("text"), F.concat(F.lit("s"), F.lpad((F.col("id") % n).cast("string"), 4, "0")).alias("source"))
    want = brute_targets({f"s{i:04}": 30 for i in range(n)})
    got = mixing.mix(df, slots=1 << 12).collect()
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items()) and abs(sum(taken.values()) - 45 * n) <= n


def test_five_thousand_sources(spark):
    import time

    n, t0 = 5_000, time.perf_counter()
    df = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.lit(" ".join("w" * 10)).alias("text"), (F.col("id") % n).cast("string").alias("source"))
    assert abs(mixing.mix(df).agg(F.sum("taken")).first()[0] - 45 * n) <= n
    assert time.perf_counter() - t0 < 60


# -- language identification ----------------------------------------------------------------


def test_languages_of_held_out_documents(docs):
    out = queries.op1_language_id(docs.sparkSession, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_that_one_fold_alone_has(spark):
    import zlib as z

    fold = lambda i: z.crc32(str(i).encode()) % 5
    texts = {"en": "the quick brown fox jumps over the lazy dog and runs away", "de": "der schnelle braune Fuchs springt über den faulen Hund", "ru": "быстрая лиса прыгает через ленивую собаку и бежит"}
    ids = iter(range(10_000))
    rows = [(next(i for i in ids if fold(i) not in ((0, 1) if lang == "ru" else (0,)) or (lang == "ru" and fold(i) == 1)), texts[lang], lang) for lang in ("en", "de") for _ in range(30)]
    rows += [(next(i for i in ids if fold(i) == 1), texts["ru"], "ru") for _ in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    out = language_id.predict(spark.createDataFrame([(1, "собака и лиса бежит"), (2, "the dog runs"), (3, "der Hund springt")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(out, key=lambda r: r["doc_id"])] == ["ru", "en", "de"]


def test_scripts_beyond_the_first_plane(spark):
    import zlib as z

    rng = random.Random(4)
    scripts = {"got": range(0x10330, 0x10340), "ff": range(0x1E922, 0x1E930)}
    word = lambda s: "".join(chr(rng.choice(s)) for _ in range(5))
    rows = [(i, " ".join(word(s) for _ in range(30)), lang) for i, (lang, s) in enumerate((x for _ in range(40) for x in scripts.items()))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [r for r in rows if z.crc32(str(r[0]).encode()) % 5 == 0]
    out = language_id.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()
    assert held and all(r["lang_pred"] == r["lang"] for r in out)


def test_language_edges(odd, empty, docs):
    model = language_id.fit(docs)
    out = language_id.predict(odd, model, "text")
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[0]["score"] == 0.0 and by[0]["rejected"]
    assert by[12]["lang_pred"] in model.langs and out.count() == odd.count()
    assert "score" in out.columns and out.columns.count("score") == 1
    assert language_id.predict(empty, model, "text").count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, "text").collect()} == {"und"}
    noise = docs.sparkSession.createDataFrame([(1, "zxqj vkw qqzx jjxk " * 30)], "doc_id long, text string")
    assert language_id.predict(noise, model, "text").first()["rejected"]


def test_no_counted_run_is_lost(docs, monkeypatch):
    """Shards of any size, kept or read again, give the scores of the whole model."""
    monkeypatch.setattr(language_id, "KEPT", 5_000)
    few = docs.where("doc_id < 300").select("doc_id", "lang", "text")
    whole, cut = (language_id.fit(few, entries=n) for n in (1 << 30, 700))
    assert max(len(places) for levels in cut.orders for places in levels) > 5
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["entropy"], r["score"], r["rejected"]) for r in language_id.predict(few, m, "text").collect()) for m in (whole, cut))
    assert a == b


def test_pruned_model_still_tells_languages_apart(docs):
    out = language_id.predict(docs.select("doc_id", "lang", "text"), language_id.fit(docs, entries=500), "text").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


# -- vectors --------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max(((n, d) for d, n in Counter(len(v) for _, v in ok).items()), default=(0, 0))[1]
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = {}
            for j, v in ok:
                if j != i:
                    d = float(np.sqrt(((v - q) ** 2).sum()))
                    near[j] = min(near.get(j, math.inf), d)
            out[i] = sorted((round(d, 9), j) for j, d in near.items())[:k]
    return out


def _found(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], round(r["score"], 9), r["vec_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 20)).astype(np.float32))]
    same = rows[17][1]
    rows += [(500 + i, same) for i in range(60)]
    rows += [(600, None), (610, []), (620, [0.0] * 20), (630, [math.nan] * 20), (640, [math.inf] + [1.0] * 19), (650, [None] + [1.0] * 19), (660, [1.0] * 7), (None, same), rows[0], rows[17]]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score long").repartition(6)
    want = brute_nearest(rows, 10, 10)
    for slice_bytes in (1 << 24, 2000):
        assert _found(vector_search.search(df, F.col("vec_id") % 10 == 0, 10, slice_bytes=slice_bytes)) == want


def test_recall_of_the_registered_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute_nearest(rows, 10, 100), _found(queries.op2_vector_search(spark, SF))
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    assert _found(vector_search.search(two, F.col("vec_id") % 100 == 0, 10)) == {0: [(0.0, 1), (2.0, 2)]}
    assert vector_search.search(two.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
    assert vector_search.search(two, F.col("vec_id") == 9, 10).count() == 0


# -- quality --------------------------------------------------------------------------------


def test_quality_rules_of_held_out_documents(docs, labels):
    out = queries.op3_quality_rules(docs.sparkSession, SF).join(labels.withColumnRenamed("quality", "q"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["q"]) for r in out) >= 0.97 * len(out)


def test_quality_classifier_of_held_out_documents(docs, labels):
    out = queries.op8_quality_classifier(docs.sparkSession, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_quality_edges(odd, empty, docs, labels):
    from test_units import brute_statistics

    no_labels = labels.limit(0)
    one = labels.where("quality = 1")
    twice = labels.unionByName(labels.limit(30)).unionByName(docs.sparkSession.createDataFrame([(None, 1, 0), (1, None, 0), (2, 5, 0)], labels.schema))
    for given in (no_labels, one, twice):
        rules = quality_rules.fit(docs, given, rows=64, steps=20)
        out = quality_rules.judge(odd, rules).collect()
        assert len(out) == odd.count() and all(0 <= r["quality"] <= 1 for r in out)
        model = quality_classifier.fit(docs, given, rows=64)
        scored = quality_classifier.score(odd, model, "text", "score")
        assert scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in scored.collect())
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in out:
        if r["doc_id"] in texts:
            assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == brute_statistics(texts[r["doc_id"]])
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality_rules.judge(empty, rules).count() == 0
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.fit(empty, labels).prior == 0.5


def test_votes_against_brute_force(docs, labels):
    model = quality_classifier.fit(docs, labels, rows=50)
    texts = [r["text"] for r in docs.limit(40).collect()]
    import pyarrow as pa

    got = model.score(pa.array(texts))
    v = quality_classifier._vectors(pa.array(texts))
    for i in range(len(texts)):
        x = (v[i] - model.mean) @ model.basis
        cos = sorted(((float(x @ n / np.linalg.norm(x)), float(w), float(y)) for n, w, y in zip(model.near, model.w, model.y, strict=True)), reverse=True)[: quality_classifier.NEIGHBOURS]
        vote = [(max(c, 0) ** 4 * w, y) for c, w, y in cos]
        assert math.isclose(got[i], sum(a * y for a, y in vote) / sum(a for a, _ in vote), abs_tol=2e-3)


# -- urls and pages -------------------------------------------------------------------------


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(r), r, v) for v, r in rules for h, p in [(r.split("/", 1)[0], r[len(r.split("/", 1)[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme/net/", "http://net", "http://net/", "HTTP://A.NET/x?y://z", "http://www.Example.net/en/1", "http://example.net/en", "http://xexample.net/en/", "http://example.com/de/x#f", "x://m.example.com/de",
        "http://org/fr/", "http://a.org/fr/x", "http://a.org/fr", "http://?q", "http:///en/", "http://É.net/ü", "http://a..net/", "http://.net/", "http://net./", "ftp://example.net:80/en/", "http://a\nb.net/\nc"]


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    many = queries.URL_RULES + [("block", f"site{i}.example/") for i in range(300)] + [("allow", f"site{i}.example/ok") for i in range(0, 300, 3)]
    more = df.unionByName(spark.createDataFrame([(1000 + i, f"http://www.site{i}.example/{'ok' if i % 2 else 'no'}/{i}", "h") for i in range(600)], df.schema))
    for rules, pages in ((queries.URL_RULES, df), (many, more), ([], df)):
        got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, rules).collect())
        want = sorted((r["page_id"], *(x or "" for x in brute_url(r["url"], rules))) for r in pages.collect())
        assert got == want
    inner = pages.select("*", *(F.lit(c).alias(c) for c in ("_host", "_path", "_keys", "_best", "_allow0", "_block0", "row", "host")))
    out = url_filter.judge(inner, queries.URL_RULES)
    assert set(out.columns) == {*pages.columns, "_host", "_path", "_keys", "_best", "_allow0", "_block0", "row", "host", "path", "rule", "verdict"}
    assert all(r["_host"] == "_host" and r["_block0"] == "_block0" and r["host"] != "host" for r in out.collect())
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = keys.where("crc32(key) % 29 = 0")
    cascade = url_filter.build(listed, keys)
    assert len(cascade.levels) > 1
    out = cascade.attach(keys, "_c").select("key", cascade.lists(F.col("key"), "_c").alias("in"))
    assert out.where(F.col("in") != (F.crc32("key") % 29 == 0)).count() == 0


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x y</p>", 5, "t"), (1, "u", "<p>x y</p>", 5, "t"), (2, None, None, None, None), (3, "v", "", 1, "z")], "page_id long, url string, html string, n_chars long, text string")
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert out == [(1, "x y", 3), (1, "x y", 3), (2, "", 0), (3, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0
    for r in queries.op7_html_extract(spark, SF).collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "©" not in r["text"]


# -- empty tables ---------------------------------------------------------------------------


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(empty).count() == 0
