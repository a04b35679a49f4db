"""Main text of web pages by tree scoring, in Arrow batches.

A page is read into a tree that repairs what browsers repair here: void elements, implied
ends of paragraphs, items and cells, unclosed elements, comments and raw text, and a tag cut
off at the end.  Blocks are the runs of text between block-level tags.  Elements that by
their name or style are menus, page headers, footers, asides, scripts, styles or hidden take
no part.  Forms, roles, and classes or ids that mark menus, sidebars, notices, adverts or reader
comments lower the points of what they enclose, and such an element is left out unless it
holds the best container; names with other meanings count only as a whole class word, and
inside a longer one only if most of the text is in links.  Each block gives points for its
length and its commas to its element, half of them to the element above and less further
up, to ``LEVELS`` elements; a container's points are discounted by the share of its text that
is in links.  The best container (or the article that encloses it) is kept, with siblings
that score well enough.

Null and empty pages, pages without text: empty text.  A raw element without an end tag, as
``svg`` or ``noscript``, is passed over as if its tag were not there; only scripts and styles run
to the end of the page then.  Repeated rows are read each; whole pages of any length and depth
are read in time proportional to their length.  Empty tables give empty results.  Columns of
the input named ``text`` or ``n_chars`` are replaced, others pass through.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: HTML element classes (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br_ center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body head html option optgroup td th tr tbody thead tfoot caption legend summary".split())
#: An opening tag ends an open element of these names, up to the given enclosing ones.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside script style noscript iframe template svg annotation annotation-xml select button textarea input object embed canvas dialog menu head title search audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Raw elements that run to the end of the page if they are not ended.
TO_THE_END = frozenset(["script", "style"])
#: Words in a class or id that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar sidenav sidecol rail widget widgets comment comments commentlist "
    "disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related "
    "recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation topnav topbar footer masthead pagination pager toolbar skip hidden feedback".split())
#: Marks that have other meanings within longer class words.
AMBIGUOUS = frozenset("ad ads rail widget widgets reply replies respond notice notices alert overlay share sharing social related recommended promo promotion subscription signup login skip hidden feedback banner sponsored comment consent".split())
#: First and last parts of class words that tell a state of a layout, not what an element is.
STATES = (frozenset("has no is with without".split()), frozenset("open closed".split()))
PENALTY = 0.2
SHORT = 25
#: Elements above a block that get points from it.
LEVELS = 64
_PAGE = frozenset(["html", "body", "main"])
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class _Node:
    __slots__ = ("tag", "up", "out", "mark", "marked", "block", "holder", "article", "link", "points", "linked")

    def __init__(self, tag: str, up: _Node | None, out: bool, mark: int = 0):
        self.tag, self.up, self.out, self.mark = tag, up, out, mark
        self.marked = mark == 2 or (up is not None and up.marked)
        self.block = tag in BLOCK
        # the block-level element that text in it belongs to
        self.holder = self if self.block or up is None else up.holder
        self.article = tag in ("article", "main") or (up is not None and up.article)
        self.link = tag == "a" or (up is not None and up.link)
        self.points = self.linked = 0.0


class _Stack:
    """Open elements, with the places of each tag's, so that the nearest of a name is known."""

    def __init__(self, root: _Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        for node in reversed(self.nodes[at:]):
            self.places[node.tag].pop()
        del self.nodes[at:]

    def last(self, names) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)


def _hidden(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element, by its name and attributes, is never main text."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in _PAGE:
        return False
    for m in _ATTR.finditer(attributes):
        name = m[1].lower()
        value = unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _mark(tag: str, attributes: str) -> int:
    """2: a form, or a role, class or id that marks what is not main text; 1: an ambiguous mark
    within a class word."""
    if tag == "form":
        return 2
    if not attributes or tag in _PAGE:
        return 0
    mark = 0
    for m in _ATTR.finditer(attributes):
        if m[1].lower() == "role" and unescape(m[2] or m[3] or m[4] or "").strip().lower() in ROLES:
            return 2
        if m[1].lower() not in ("class", "id"):
            continue
        for word in unescape(m[2] or m[3] or m[4] or "").split():
            parts = [t.lower() for t in _TOKEN.findall(word)]
            if word.lower() in MARKS:
                return 2
            if not parts or parts[0] in STATES[0] or parts[-1] in STATES[1]:
                continue
            met = MARKS.intersection(parts)
            if met - AMBIGUOUS:
                return 2
            mark = max(mark, int(bool(met)))
    return mark


def _blocks(html: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """(element, text) of each run of text between block-level tags, in page order, and all
    elements, each after the one that encloses it."""
    root = _Node("html", None, False)
    stack, nodes, out, text, owner = _Stack(root), [root], [], [], root
    unended: set[str] = set()

    def flush():
        if text:
            if s := " ".join("".join(t for t, _ in text).split()):
                linked = sum(len(t) for t, link in text if link)
                owner.linked += min(len(s), linked)
                out.append((owner, s))
            text.clear()

    def close(names, limits=frozenset()):
        at = stack.last(names)
        if at > 0 and at >= stack.last(limits):
            if any(n.block for n in stack.nodes[at:]):
                flush()
            stack.cut(at)

    def say(s: str):
        nonlocal owner
        top = stack.nodes[-1]
        if s and not top.out:
            if not text:
                owner = top.holder
            text.append((unescape(s) if "&" in s else s, top.link))

    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        kind = html[lt + 1 : lt + 2]
        if kind and kind in "!?" or (kind == "/" and not html[lt + 2 : lt + 3].isalpha()):
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        if not (kind.isascii() and kind.isalpha()) and kind != "/":
            say("<")
            at = lt + 1
            continue
        if lt > last:
            break  # a tag cut off by the end of the page
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                say(" ")
            else:
                close(frozenset([tag]), frozenset(["table", "td", "th"]) - {tag} if tag not in ("table", "tbody", "tr", "body", "html") else frozenset())
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P:
            close(frozenset(["p"]), frozenset(["td", "th", "button", "table"]))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("html", "body") and len(stack.nodes) > 1:
            continue
        if tag == "body":
            close(frozenset(["head"]))
        if tag == "a":
            close(frozenset(["a"]), frozenset(["td", "th", "table"]))
        if tag in VOID:
            continue
        up = stack.nodes[-1]
        if up.tag == "head" and tag not in RAW and tag not in ("head", "base", "link", "meta"):
            stack.cut(len(stack.nodes) - 1)
            up = stack.nodes[-1]
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            stop = None if tag in unended else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(html, at)
            if stop:
                close_at = html.find(">", stop.start())
                at = end if close_at < 0 else close_at + 1
            elif tag in TO_THE_END:
                at = end
            else:
                unended.add(tag)
            continue
        node = _Node(tag, up, up.out or _hidden(tag, m[3], up.article), _mark(tag, m[3]))
        stack.push(node)
        nodes.append(node)
    flush()
    return out, nodes


def _totals(blocks: list[tuple[_Node, str]], nodes: list[_Node]) -> tuple[dict[_Node, float], dict[_Node, float]]:
    """Text and linked text of all that an element encloses, for elements that enclose some."""
    chars: dict[_Node, float] = {}
    linked: dict[_Node, float] = {}
    for node, s in blocks:
        chars[node] = chars.get(node, 0.0) + len(s)
        linked[node] = node.linked
    # what encloses comes first, so from the back every element is complete when it is passed on
    for n in reversed(nodes):
        if n in chars and n.up is not None:
            chars[n.up] = chars.get(n.up, 0.0) + chars[n]
            linked[n.up] = linked.get(n.up, 0.0) + linked[n]
    return chars, linked


def _inside(nodes: list[_Node], chosen) -> set[_Node]:
    """The elements that are chosen or lie in one that is."""
    out: set[_Node] = set()
    for n in nodes:
        if n.up in out or chosen(n):
            out.add(n)
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by empty lines."""
    blocks, nodes = _blocks(html or "")
    chars, linked = _totals(blocks, nodes)

    def dropped(n: _Node) -> bool:
        return bool(n.mark) and n in chars and (linked[n] > 0.5 * chars[n] or (n.mark == 2 and chars[n] < SHORT))

    out = _inside(nodes, dropped)
    blocks = [(n, s) for n, s in blocks if n not in out]
    if not blocks:
        return ""
    chars, linked = _totals(blocks, nodes)
    scored: dict[_Node, None] = {}
    for node, s in blocks:
        points = 1.0 + s.count(",") + min(len(s) / 100.0, 3.0)
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "th", "figcaption"):
            points *= 0.25
        if node.marked:
            points *= PENALTY
        level, up = 0, node if node.tag in ("div", "section", "article", "main", "td", "body", "html") else node.up
        while up is not None and level < LEVELS:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[up] = None
            level, up = level + 1, up.up

    def worth(n: _Node) -> float:
        bonus = 1.5 if n.tag in ("article", "main") else 1.0
        return bonus * n.points * (1.0 - min(1.0, linked.get(n, 0.0) / max(1.0, chars.get(n, 0.0))))

    best = max(scored, key=worth)
    top = best
    while top is not None and top.tag not in ("article", "main"):
        top = top.up
    best = top or best
    within = set(_path(best))
    out = _inside(nodes, lambda n: n.mark == 2 and n not in within)
    enough = max(2.0, 0.2 * worth(best))
    keep = {best}
    if best.tag not in ("body", "html"):
        for n in nodes:
            if n.up is best.up and n in chars and n not in out:
                dense = linked[n] > 0.25 * max(1.0, chars[n])
                if not dense and (worth(n) >= enough or n.tag in ("p", "h1", "h2", "h3", "blockquote", "pre")):
                    keep.add(n)
    kept = _inside(nodes, keep.__contains__)
    return "\n\n".join(s for n, s in blocks if n in kept and n not in out)


def _path(n: _Node | None):
    while n is not None:
        yield n
        n = n.up


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` without ``column``, with ``text`` and ``n_chars`` (its code points)."""
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    kept = [f for f in df.schema.fields if f.name not in (column, "text", "n_chars")]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(h.as_py()) for h in part.column(column)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], [*names, "text", "n_chars"])

    return df.select(*names, column).mapInArrow(run, T.StructType([*kept, *added]))
