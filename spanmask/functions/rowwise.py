"""Layer 1 and chunking of one Python string, for SQL functions and table functions.

The grammars are Python's, so they run as they are.  The Column expressions of ``detectors``,
``spans`` and ``chunks`` are the way for DataFrames; tests hold both against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterator

from . import patterns as P

Range = tuple[int, int]
Span = tuple[int, int, str]

_FOUND = {label: re.compile(g) for label, g in P.DETECTOR_GRAMMARS.items() if label != "ADDRESS"}
# the starter's first letters keep the search for an address off most places
_ADDRESS = re.compile("(?=[FHDPTBSN])" + P.ADDRESS_BODY)
_FORM = re.compile(P.ADDRESS_FORM_LINE)
_PIN = re.compile(P.PIN_GRAMMAR)
_PARAGRAPH, _SENTENCE = re.compile(P.PARAGRAPH_GRAMMAR), re.compile(P.SENTENCE_END_GRAMMAR)
_DIGIT = re.compile(r"\d")


def _addresses(text: str, pins: Container[str]) -> Iterator[Span]:
    """Matches that do not start at a labelled form (V2) and hold a registered PIN (V1)."""
    at = 0
    while m := _ADDRESS.search(text, at):
        if _FORM.match(text, m.start()):
            at = m.start() + 1
            continue
        at = m.end()
        pin = _PIN.search(m[0])
        if pin and pin[0] in pins:
            yield m.start(), m.end(), "ADDRESS"


def candidates(text: str, pins: Container[str] = ()) -> list[Span]:
    """All detectors' matches."""
    has_digit, has_at = _DIGIT.search(text), "@" in text
    out = []
    for label, found in _FOUND.items():
        if label == "SECRET" or (has_at if label in ("EMAIL", "UPI") else has_digit):
            out += [(m.start(), m.end(), label) for m in found.finditer(text) if label != "POSTAL_CODE" or len(m[0]) != 6 or m[0] in pins]
    if has_digit and "\n" in text:
        out += _addresses(text, pins)
    return out


def spans(text: str | None, pins: Container[str] = ()) -> list[Span]:
    """The spans that leftmost-longest resolution keeps."""
    order = {label: i for i, label in enumerate(P.DETECTOR_ORDER)}
    kept, at = [], 0
    for span in sorted(candidates(text or "", pins), key=lambda s: (s[0], -s[1], order[s[2]])):
        if span[0] >= at:
            kept.append(span)
            at = span[1]
    return kept


def masked(text: str | None, pins: Container[str] = ()) -> str:
    """The text with ``[LABEL]`` for each kept span (P3); "" for none."""
    text, out, at = text or "", [], 0
    for start, end, label in spans(text, pins):
        out += [text[at:start], f"[{label}]"]
        at = end
    return "".join([*out, text[at:]])


class Pins:
    """A set of PINs as a bitmap of fixed size, small enough to travel with a function."""

    _FIRST = 100_000

    def __init__(self, pins: Iterator[int]):
        bits = bytearray(100_000)
        for p in pins:
            bits[(p - self._FIRST) >> 3] |= 1 << ((p - self._FIRST) & 7)
        self.bits = bytes(bits)

    def __contains__(self, pin: str) -> bool:
        # the grammar's digits may be of any script; registries hold ASCII digits
        if not (len(pin) == 6 and pin.isascii() and pin.isdigit() and "1" <= pin[0] <= "8"):
            return False
        at = int(pin) - self._FIRST
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


# ---- chunking (C1-C4) --------------------------------------------------------------
def _units(text: str, separator: re.Pattern) -> list[Range]:
    """Ranges that end after each separator; the rest of the text is the last one."""
    ends = [*(m.end() for m in separator.finditer(text)), len(text)]
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]


def _windows(start: int, end: int, size: int, overlap: int) -> list[Range]:
    step, out = max(1, size - overlap), []
    while start < end:
        out.append((start, min(start + size, end)))
        if start + size >= end:
            break
        start += step
    return out


def _packed(units: list[Range], size: int, oversize: Callable[[Range], list[Range]]) -> list[Range]:
    """Neighbouring units together as far as they fit."""
    out, first, last = [], 0, 0
    for start, end in units:
        if end - first <= size:
            last = end
            continue
        if last > first:
            out.append((first, last))
        if end - start > size:
            out += oversize((start, end))
            first = end
        else:
            first = start
        last = end
    return [*out, (first, last)] if last > first else out


def _sentences(text: str, size: int, overlap: int) -> list[Range]:
    units = _units(text, _SENTENCE)
    if len(units) == 1:
        return _windows(0, len(text), size, overlap)
    return _packed(units, size, lambda u: _windows(*u, size, overlap))


def chunk_ranges(text: str | None, size: int = 1600, overlap: int = 200) -> list[Range]:
    """Paragraph-aware chunks of a text (C4), in order."""
    text = text or ""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    if not _PARAGRAPH.search(text):
        return _sentences(text, size, overlap)
    units = _units(text, _PARAGRAPH)
    if len(units) == 1:
        return _windows(0, len(text), size, overlap)
    tail = units[-1]

    def oversize(unit: Range) -> list[Range]:
        part = text[unit[0] : unit[1]]
        # only a last paragraph without a break after it is cut at sentences
        if unit == tail and not _PARAGRAPH.search(part):
            return [(unit[0] + a, unit[0] + b) for a, b in _sentences(part, size, overlap)]
        return _windows(*unit, size, overlap)

    return _packed(units, size, oversize)


def gaps(length: int, covered: list[Range]) -> list[Range]:
    """Ranges outside the covered ones (P6), which may be nested or in any order."""
    out, at = [], 0
    for start, end in sorted(covered):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, length)] if length > at else out


def segment_chunks(text: str, covered: list[Range], size: int, overlap: int) -> list[Range]:
    """Chunks of every uncovered segment, in text offsets."""
    return [(a + start, a + end) for a, b in gaps(len(text), covered) for start, end in chunk_ranges(text[a:b], size, overlap)]
