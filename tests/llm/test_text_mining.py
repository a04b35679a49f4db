"""Phrase collocations, byte-pair encoding and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanmask.llm import bpe, collocations, queries, source_divergence

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, ids string, decoded string, rank int, n long, term string, score double"


def _frame(spark, rows, parts=4):
    """Rows (text, lang, source) with columns of clashing names."""
    return spark.createDataFrame([(i, *r, "x", "y", 1, 2, "t", 0.5) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- collocations ---------------------------------------------------------------------------
def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _phrases(rows, longest):
    """Occurrences of every phrase by language, counted one by one."""
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    return f, n


def _collocations(rows, longest=4, least=30, top=2000, covered=80):
    out, (every, n) = [], _phrases(rows, longest)
    for lang, f in every.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in found.items():
            holds = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in holds):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _texts(seed):
    """Sentences with repeated passages, rings of words, odd spaces and every kind of end."""
    rng = random.Random(seed)
    few, many = ["la", "Lo", "né", "äß", "x́", " ", "a|b"], [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(many) for _ in range(30))
    rows = [(None, "en", "s"), ("", None, None), (" \n\t,", "de", ""), ("one", "", "s"), ("la " * 400, "en", "s"), ("la lo né " * 150, None, "s")]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice((few, many, few[:3]))
            parts.append(rng.choice((passage, passage[:60], rng.choice(("\t", " ", "  ")).join(rng.choice(words) for _ in range(rng.randint(0, 12))))))
        text = "".join(p + rng.choice((". ", ",", ";", "\n", "\x0b", "\r\n", "!?", ": ", " ")) for p in parts)
        rows += [(text, rng.choice(("en", "en", "en", "de", None)), "s")] * rng.choice((1, 1, 1, 4))
    return rows


@pytest.mark.parametrize(("seed", "longest", "least", "chunk"), [(1, 4, 30, 1 << 21), (2, 4, 3, 700), (3, 4, 1, 300), (4, 3, 5, 1500), (5, 2, 4, 1 << 21), (6, 5, 2, 900)])
def test_collocations_equal_counting(spark, seed, longest, least, chunk):
    rows = _texts(seed)
    got = collocations.collocations(_frame(spark, rows), longest=longest, least=least, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == _collocations(rows, longest, least)


def test_counts_of_all_phrases_follow_from_paths(spark):
    rows = _texts(7)
    paths = collocations.weighted_paths(_frame(spark, rows), least=2, chunk=1000)
    assert paths.where("size > 4").count() > 0
    counts, totals = collocations.phrase_counts(paths)
    every, n = _phrases(rows, 4)
    want = {(lang, " ".join(p)): f for lang, c in every.items() for p, f in c.items() if f >= 2}
    assert {(r["lang"], r["phrase"]): r["f"] for r in counts.where("f >= 2").collect()} == want
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_passages_of_many_texts_are_one_path(spark):
    passage = " ".join(f"word{i}" for i in range(50))
    paths = collocations.weighted_paths(_frame(spark, [(passage, "en", "s")] * 200), least=30)
    assert {(r["gram"], r["size"]) for r in paths.collect()} == {(passage, 50), (" ".join(f"word{i}" for i in range(47, 50)), 3), ("word48 word49", 2), ("word49", 1)}


def test_collocations_limit_ranks_and_empty(spark, empty):
    rows = _texts(8)
    got = collocations.collocations(_frame(spark, rows), least=2, top=7, chunk=2000)
    assert sorted(map(tuple, got.collect())) == _collocations(rows, least=2, top=7)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(_frame(spark, [(None, None, None), ("", "en", "s")])).collect() == []


def test_long_texts_are_cut_between_pieces():
    text = ("some words here, and more " * 500 + "x" * 3000 + " end").encode()
    parts = list(collocations._slices(text, 1000))
    assert b"".join(parts) == text and all(p.endswith(b",") for p in parts[:-1]) and len(parts) > 10


# -- byte-pair encoding ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_padding()
    tok.no_truncation()
    return tok


def _odd_texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdehinotuABC ÉéßΣςİıﬁ中한é́'’.,<>|/w0123½²\t\n\u0085 ​🙂̸=K\x00\x1c"
    texts = ["", "   ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>x", "</w>", "a</w>b", "don't I'M we'LL'd", "x" * 3000, "the" * 900, "<|endoftext", "abc<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return texts + ["".join(rng.choice("abcdeinthgou") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_encoder_and_decoder_equal_the_library(library):
    coder = bpe.Bpe(queries.tokenizer_path())
    assert coder.plain
    for text in _odd_texts(5, 3000):
        ids = library.encode(text, add_special_tokens=False).ids
        mine = coder.encode(text.encode())
        assert list(memoryview(mine).cast("I")) == ids, text
        assert coder.decode(bpe.np.frombuffer(mine, "<u4")).decode() == library.decode(ids, skip_special_tokens=False), text


def test_merges_equal_merging_by_rank():
    """Random small vocabularies, where many tokens compete."""
    rng = random.Random(9)
    for _ in range(40):
        symbols, merges, texts = 3, [], {"abc"[i]: i for i in range(3)}
        while len(merges) < 25:
            a, b = rng.choice(list(texts)), rng.choice(list(texts))
            if a + b not in texts and len(a + b) < 9:
                merges.append((texts[a], texts[b]))
                texts[a + b] = symbols + len(merges) - 1
        table = bpe.Merges(symbols, merges)
        for _ in range(60):
            word = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
            plain = list(word)
            while True:
                pairs = [(table.joined[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in table.joined]
                if not pairs:
                    break
                token, i = min(pairs)
                plain[i : i + 2] = [token]
            assert table.encode("".join(chr(bpe._FIRST + s) for s in word)) == plain


def test_long_words_take_linear_time():
    import time

    coder, rng = bpe.Bpe(queries.tokenizer_path()), random.Random(1)
    word = "".join(rng.choice("abcdeinthgou") for _ in range(400_000)).encode()
    spent = []
    for n in (50_000, 400_000):
        t = time.perf_counter()
        coder.encode(word[:n])
        spent.append(time.perf_counter() - t)
    assert spent[1] < 30 * spent[0] + 1


def test_bpe_columns_nulls_and_slices(spark, library, empty, monkeypatch):
    texts = [None, *_odd_texts(6, 40)]
    df = _frame(spark, [(t, "en", "s") for t in texts])
    path = queries.tokenizer_path()
    out = bpe.decode(bpe.encode(df, path), path)
    assert set(out.columns) == set(df.columns)
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty, path), path).collect() == []
    no_ids = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(no_ids, path).first()["decoded"] == ""
    coder = bpe.Bpe(path)
    whole = coder.encode(("alpha beta, gamma " * 200).encode())
    monkeypatch.setattr(bpe, "SLICE", 64)
    assert coder.encode(("alpha beta, gamma " * 200).encode()) == whole
    ids = bpe.np.frombuffer(whole, "<u4")
    assert coder.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_op12_digests(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want


def test_other_kinds_of_tokenizer_are_refused(tmp_path):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["byte_fallback"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="plain byte-pair"):
        bpe.Bpe(str(path))


# -- source divergence ----------------------------------------------------------------------
def _audit(rows, least_docs=10, top=10):
    groups, whole, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or ""))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        for (of, _), c in groups.items():
            if of == lang:
                whole[lang].update({t: c[t] for t in kept})

        def rates(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        by_source = {s: rates(c) for (of, s), c in groups.items() if of == lang}
        all_rates = rates(whole[lang])
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in by_source.items():
            pairs = [(-sum(f(p[t], q[t]) for t in kept), o.encode()) for o, q in by_source.items() if o != s]
            terms = [(-f(p[t], all_rates[t]), t.encode()) for t in kept if groups[lang, s][t] and p[t] > all_rates[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def _sources(seed, n_sources=7, n=300, vocabulary=150):
    rng = random.Random(seed)
    words = [rng.choice(("w{}", "Ä{}", "中{}", "it's{}", "x_{}-y")).format("abcdefgh"[i % 8] * (i // 8 + 1)) for i in range(vocabulary)]
    rows = [(None, None, None), ("", "fr", "only"), ("12 34", "fr", "digits"), (None, "en", "silent"), ("rare", "", "")]
    for _ in range(n):
        s = rng.randrange(n_sources)
        text = " ".join(words[min(int(rng.expovariate(0.03 + 0.01 * s)), vocabulary - 1)] for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(("en", "en", "de", None)), None if s == 3 else f"s{s}"))
    return rows


@pytest.mark.parametrize(("block", "tile", "held"), [(2048, 64, 1 << 18), (70, 2, 50), (1, 1, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, tile, held):
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "HELD", held)
    rows = _sources(block)
    got = source_divergence.audit(_frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == _audit(rows)


def test_divergence_of_large_counts_is_exact(spark):
    counts = spark.createDataFrame([("en", "a", None, 0, 0, 0), ("en", "a", "x", 3 * 10**12, 4 * 10**12, 1), ("en", "b", "x", 10**12, 4 * 10**12, 0), ("en", "a", "y", 7, 8, 1), ("en", "b", "y", 1, 8, 0), ("en", "c", None, 0, 0, 0)],
                                   "lang string, source string, term string, n long, n_lang long, first long")
    groups = source_divergence._totals(counts)
    got = {(r["source"], r["item"]): r["value"] for r in source_divergence.pair_values(counts, groups).collect()}
    have = {"a": (3 * 10**12, 7), "b": (10**12, 1), "c": (0, 0)}
    p = {s: [1 + 10**9 * (x + 2) // (sum(c) + 4) for x in c] for s, c in have.items()}
    want = {(s, o): sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o], strict=True)) for s in have for o in have if s != o}
    assert got == want


def test_divergence_in_slices_and_empty(spark, empty, monkeypatch):
    text = ("Ärger und Freude; x1y " * 300).encode()
    whole = source_divergence._terms(text.lower())
    monkeypatch.setattr(source_divergence, "SLICE", 16)
    assert source_divergence._terms(text.lower()) == whole
    assert source_divergence.audit(empty).collect() == []


def test_bitmaps_hold_each_term_once_a_group(spark, docs):
    counts = source_divergence.term_counts(docs.where("lang = 'de'")).cache()
    sets = source_divergence.bitmaps(counts, source_divergence._totals(counts))
    assert sets.agg(F.sum(F.bit_count("bits"))).first()[0] == counts.where("term is not null").count()
