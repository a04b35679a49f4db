"""Helpers of the training-data operators, held against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanmask.llm import blocks, html_extract, language_id, packing, quality_rules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "  \n", "a", "one two  two\tthree\nfour", "é\x0bß\x1cü x", "x" * 5000, "a b " * 300, "Привет мир\r\nмир"]


def test_words_are_the_maximal_runs():
    w = blocks.Words.of(pa.array(TEXTS))
    raw = "".join(t or "" for t in TEXTS).encode()
    for i, t in enumerate(TEXTS):
        mine = [raw[w.start[j] : w.end[j]].decode() for j in range(w.first[i], w.first[i + 1])]
        assert mine == WORD.findall(t or "")


def test_words_of_a_slice_with_offsets():
    column = pa.array(["zero", *TEXTS, "last one"]).slice(1, len(TEXTS))
    assert blocks.Words.of(column).count.tolist() == [len(WORD.findall(t or "")) for t in TEXTS]


def test_equal_runs_have_equal_hashes_wherever_they_are():
    w = blocks.Words.of(pa.array(["p q r s t q r s", "q r s"]))
    h = w.window_hashes(w.hashes(), 3, np.array([1, 5, 8]))
    assert len(set(h.tolist())) == 1
    assert len(set(w.window_hashes(w.hashes(), 3).tolist())) == 5


def test_planes_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (blocks.unplanes(blocks.planes(v)) == v).all()
    assert len(blocks.unplanes(blocks.planes(v[:0]))) == 0


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_statistics_against_brute_force():
    rng = random.Random(3)
    texts = TEXTS + ["\n".join(" ".join(rng.choice("ab#|") * rng.randint(1, 2) for _ in range(rng.randint(0, 12))) for _ in range(12)) for _ in range(60)]
    s = quality_rules.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert [int(s[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_statistics(t)


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_brute_force():
    texts = [*TEXTS, "A b", "ÀB c D e", "aa bb cc dd"]
    data, offsets = blocks.utf8(pa.array(texts))
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    fp = simhash.majority(*simhash._shingle_hashes(blocks.Words(lower, offsets), 3))
    assert fp.tolist() == [brute_fingerprint(t) for t in texts]


def _classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("spread", [2, 12, 64])
def test_forest_connects_what_links_connect(spread):
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    x = np.repeat(centre, 40)
    for _ in range(2):
        x = x ^ (np.uint64(1) << rng.integers(0, spread, len(x)).astype(np.uint64))
    x = np.unique(x)
    a, b = x[::2], x[1::2]
    for left, right in ((x, None), (a, b)):
        nodes = left if right is None else np.concatenate([left, right])
        want = [(i, j) for i in range(len(left)) for j in (range(i) if right is None else range(len(left), len(nodes))) if bin(int(nodes[i] ^ nodes[j])).count("1") <= 3]
        u, v = simhash._forest(left, right, 3)
        at = {int(f): i for i, f in enumerate(nodes)}
        assert _classes(len(nodes), want) == _classes(len(nodes), [(at[int(p)], at[int(q)]) for p, q in zip(u, v, strict=True)])
        assert len(u) < len(nodes)


def test_forest_with_subtiles_equals_the_direct_one(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 63, 1500).astype(np.uint64)] * 2 + [np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))]))
    y = np.unique(x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)))
    assert len(x) * len(y) > 1 << 20
    u, v = simhash._forest(x, y, 3)
    nodes = np.concatenate([x, y])
    links = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= 3)
    at = {int(f): i for i, f in enumerate(nodes)}  # a value on both sides: its distance to itself is 0
    want = _classes(len(nodes), [(at[int(x[i])], at[int(y[j])]) for i, j in links])
    got = _classes(len(nodes), [(at[int(p)], at[int(q)]) for p, q in zip(u, v, strict=True)])
    assert len(set(want)) == len(set(got)) and want == got


def test_plan_uses_every_piece_once_and_fits():
    rng = random.Random(5)
    for kind in range(6):
        lengths = [rng.randint(1, 2048) if kind % 2 else min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(rng.randint(1, 3000))]
        if kind == 4:
            lengths += [1025] * 700 + [2048] * 300
        counts = Counter(lengths)
        patterns = packing.plan(dict(counts))
        assert all(sum(p) <= 2048 and t > 0 for p, t in patterns)
        used = Counter()
        for p, t in patterns:
            for x in p:
                used[x] += t
        assert used == counts
        n, least = sum(t for _, t in patterns), max(-(-sum(lengths) // 2048), sum(x > 1024 for x in lengths))
        assert n <= least * 1.04 + 1, (kind, n, least)
    assert packing.plan({}) == []


def test_slots_cover_every_rank_without_overlap():
    patterns = packing.plan({700: 5, 648: 9, 100: 40, 2048: 2})
    slots = packing._slots(patterns)
    seen = set()
    for length, n in {700: 5, 648: 9, 100: 40, 2048: 2}.items():
        first, sequence, offset = slots[length]
        for r in range(n):
            run = np.searchsorted(first, r, side="right") - 1
            for x in range(int(offset[run]), int(offset[run]) + length):
                place = (int(sequence[run] + r - first[run]), x)
                assert place not in seen and x < 2048
                seen.add(place)


def test_kneser_ney_against_the_formula():
    """Probabilities from counts by the textbook recursion, on a small language."""
    import pandas as pd

    texts = ["abab abba", "baab", "aabb ab", "abc"]
    code, bounds, _ = language_id.runs(texts)
    assert np.diff(bounds).tolist() == [10, 5, 8, 4]
    full = Counter(code.tolist())
    levels = {4: full}
    for order in (3, 2, 1):
        levels[order] = Counter(c & ((1 << 16 * order) - 1) for c in levels[order + 1])
    rows, kinds = [], []
    for order, counts in levels.items():
        total, types = Counter(), Counter()
        for c, n in counts.items():
            total[c >> 16] += n
            types[c >> 16] += 1
        rows += [("x", order, np.uint64(c).view(np.int64), n, total[c >> 16], types[c >> 16]) for c, n in counts.items()]
        kinds.append(("x", order, sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())))
    model = language_id.Model(pd.DataFrame(rows, columns=["lang", "order", "run", "n", "total", "kinds"]), pd.DataFrame(kinds, columns=["lang", "order", "n1", "n2"]))

    def probability(c, order):
        if not order:
            return 1 / (1 + len(levels[1]))
        c &= (1 << 16 * order) - 1
        lower = probability(c, order - 1)
        mine = [n for x, n in levels[order].items() if x >> 16 == c >> 16]
        if not mine:
            return lower
        n1, n2 = (sum(n == k for n in levels[order].values()) for k in (1, 2))
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        return max(levels[order][c] - d, 0) / sum(mine) + d * len(mine) / sum(mine) * lower

    other, _, _ = language_id.runs(["abca bz"])
    every = np.unique(np.concatenate([code, other]))
    assert np.allclose(np.exp(model.log_probabilities(every)[:, 0]), [probability(int(c), 4) for c in every], rtol=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site</a> tagline</header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, accept them, or leave.</p></div><!-- <p>hidden</p> -->
<div id=main><article><h1>A title &amp; more</h1><p><b>First   line,<br>goes on.</b><p>Second &lt;para&gt;,
with a <a href=x>link</a>, and&nbsp;more.<ul><li>Item one<li>Item two</ul>
<form><input name=q><label>Your mail</label></form><aside>Related things</aside>
<table><tr><td>Cell a<td>Cell b</table><div class="ad">Buy now, buy more, buy again.</div></article></div>
<div class="comments"><p>First comment, a long one, with commas, really.</p></div><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert html_extract.main_text(PAGE) == "A title & more\n\nFirst line, goes on.\n\nSecond <para>, with a link, and more.\n\nItem one\n\nItem two\n\nCell a\n\nCell b"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain, text", "plain, text"), ("<p>cut off <b>he", "cut off he"), ("<p>cut off <a hre", "cut off"),
    ("<p>1 < 2 &am", "1 < 2 &am"), ("<p>x<script>var", "x"), ("<div><p>one</p></div><!-- open", "one"), ("<p title='a>b'>t</p>", "t"), ("<article class='comment'><p>no</p></article>", ""),
    ("<p>a</p>" * 3, "a\n\na\n\na"), ("<P>Caf&eacute; &#233;&#x41;</P>", "Café éA"),
])
def test_odd_pages(html, text):
    assert html_extract.main_text(html) == text


def test_container_without_an_article_element():
    body = "".join(f"<p>Sentence {i}, with some words, and commas, enough to count.</p>" for i in range(5))
    links = "".join(f"<li><a href=/{i}>Some link with words, number {i}</a></li>" for i in range(30))
    html = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2>{body}</div><div>tiny</div></body>"
    assert html_extract.main_text(html).split("\n\n") == ["Head", *[f"Sentence {i}, with some words, and commas, enough to count." for i in range(5)]]


PROSE = [f"Paragraph {i} of the article, with some words, and commas, enough to be counted as prose." for i in range(4)]


@pytest.mark.parametrize("tag", [
    "article class='post comments-open'", "div id='content' class='has-sidebar'", "div class='no-sidebar'", "div class='social-science'", "section class='related-party'", "div class='share-price'",
    "div class='promotion'", "article class='reply'", "div id='feedback'",
])
def test_names_of_layouts_do_not_lose_the_article(tag):
    html = f"<body><nav><a href=/>Home</a></nav><{tag}>{''.join(f'<p>{p}</p>' for p in PROSE)}<div class='comments-area'><p>A comment, of a reader, long enough.</p></div></{tag.split()[0]}><div class='sidebar'><p>Some notes, at the side, of no weight.</p></div></body>"
    assert html_extract.main_text(html).split("\n\n") == PROSE


def test_siblings_of_an_article_are_kept():
    paragraphs = "".join(f"<p>{p}</p>" for p in PROSE)
    two = f"<main><article>{paragraphs}</article><article>{paragraphs}</article></main>"
    assert html_extract.main_text(f"<body>{two}</body>").split("\n\n") == PROSE * 2
    lead = f"<div><h1>Head</h1><p>A lead, of one line.</p><article>{paragraphs}<p>One more, and long.</p></article><section>{paragraphs}</section><div><a href=/x>Some link</a></div></div>"
    assert html_extract.main_text(f"<body>{lead}</body>").split("\n\n") == ["Head", "A lead, of one line.", *PROSE, "One more, and long.", *PROSE]


def test_formulas_and_empty_drawings():
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><svg viewBox='0 0 1 1'/><p>More, and more.</p></article>") == "Let x=2 hold.\n\nMore, and more."


def test_time_grows_with_the_length():
    import time

    for unit in ("<a", "<p title=\"", "<!-- ", "<p>a<b>", "<script>", "&amp;"):
        t = time.perf_counter()
        html_extract.main_text(unit * 20_000)
        assert time.perf_counter() - t < 5, unit


@pytest.mark.parametrize(("before", "after"), [("<svg>", ""), ("<template>", ""), ("<noscript>", ""), ("<form>", "</form>"), ("<form action='/x'><input>", "</form>"), ("<div role='form'>", "</div>"), ("<div role=banner>", "</div>"), ("<svg>" * 300, "")])
def test_articles_inside_what_is_left_out_elsewhere(before, after):
    article = "<article>" + "".join(f"<p>{p}</p>" for p in PROSE) + "</article>"
    assert html_extract.main_text(f"<body>{before}{article}{after}</body>").split("\n\n") == PROSE
    # a form beside the article goes, with what is in it
    assert html_extract.main_text(f"<body>{article}<form><p>Write to us, or call, at any time of the day.</p></form></body>").split("\n\n") == PROSE


@pytest.mark.parametrize("unit", ["<div>x, y", "<b>x", "<p><table><tr><td>z", "<div></span>", "<svg>", "<div class=a>", "<ul><li>a"])
def test_time_grows_with_the_depth(unit):
    import time

    t = time.perf_counter()
    html_extract.main_text("<body>" + unit * 30_000)
    assert time.perf_counter() - t < 10


def _brute_main_text(html):
    """The scoring by its words: every element sums over the blocks it encloses, one by one."""
    blocks, nodes = html_extract._blocks(html)
    path = lambda n: list(html_extract._path(n))
    inside = lambda n: [(b, s) for b, s in blocks if n in path(b)]
    chars = lambda n: float(sum(len(s) for _, s in inside(n)))
    linked = lambda n: float(sum(b.linked for b in dict.fromkeys(b for b, _ in inside(n))))
    gone = {n for n in nodes if n.mark and inside(n) and (linked(n) > 0.5 * chars(n) or (n.mark == 2 and chars(n) < html_extract.SHORT))}
    blocks = [(b, s) for b, s in blocks if not gone.intersection(path(b))]
    if not blocks:
        return ""
    points = {}
    for b, s in blocks:
        value = (1 + s.count(",") + min(len(s) / 100, 3)) * (0.25 if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "th", "figcaption") else 1)
        value *= html_extract.PENALTY if any(n.mark == 2 for n in path(b)) else 1
        above = path(b) if b.tag in ("div", "section", "article", "main", "td", "body", "html") else path(b)[1:]
        for level, n in enumerate(above):
            points[n] = points.get(n, 0) + value / (1, 2, *(3 * k for k in range(2, level + 1)))[level]
    worth = lambda n: (1.5 if n.tag in ("article", "main") else 1) * points.get(n, 0) * (1 - min(1, linked(n) / max(1, chars(n))))
    best = max(points, key=worth)
    best = next((n for n in path(best) if n.tag in ("article", "main")), best)
    out = {n for n in nodes if n.mark == 2 and n not in path(best)}
    keep = {best}
    if best.tag not in ("body", "html"):
        for n in nodes:
            if n.up is best.up and inside(n) and not out.intersection(path(n)) and linked(n) <= 0.25 * max(1, chars(n)):
                if worth(n) >= max(2, 0.2 * worth(best)) or n.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
                    keep.add(n)
    return "\n\n".join(s for b, s in blocks if keep.intersection(path(b)) and not out.intersection(path(b)))


def test_pages_equal_brute_force_scoring():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert len(pages) == 250
    for html in pages:
        assert html_extract.main_text(html) == _brute_main_text(html)
