"""The eleven deterministic detectors as Column expressions.

Each detector scans the *original* text on its own and yields its non-overlapping
matches as candidate spans; ADDRESS and 6-digit POSTAL_CODE candidates must pass
the PIN registry (fail closed) before they take part in overlap resolution.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .spans import CAND_ARRAY, empty, find_cands, let, matches_to_cands, split_on_matches, with_cut

# Every possible PIN: six ASCII digits, the first one 1-8.  At most 800,000
# values exist, so a bitmap of 12,500 words holds any registry.
PIN_SHAPE = r"^[1-8][0-9]{5}$"
_FIRST_PIN, _PIN_WORDS = 100_000, 12_500
PIN_BITS = "__spanmask_pins"


def pin_rows(table: DataFrame, column: str = "pin") -> DataFrame:
    """Distinct PIN-shaped values of a registry table: 800,000 rows at most."""
    return table.select(F.trim(F.col(column).cast("string")).alias("pin")).where(F.col("pin").rlike(PIN_SHAPE)).distinct()


class PinRegistry:
    """Membership test for Indian PIN codes (V1).

    Built from a user table ``pin_registry(pin STRING)`` or any iterable.  Only
    PIN-shaped values can ever match, so the set is one bitmap of fixed size,
    made by Spark as a scalar subquery when the query runs: nothing is collected
    while a query is built, whatever the size of the table.  :meth:`attach` adds
    it to the rows that are tested.  No table means every 6-digit code is
    rejected, as when the registry cannot be loaded; a table that cannot be read
    raises, since its reader does.
    """

    def __init__(self, pins: Iterable[str] | None = None, table: DataFrame | None = None, column: str = "pin"):
        self.pins = None if pins is None else sorted({p for p in pins if p is not None})
        self.table, self.column = table, column

    @classmethod
    def from_table(cls, table: DataFrame | None, column: str = "pin") -> PinRegistry:
        return cls(table=table, column=column)

    def rows(self, spark) -> DataFrame | None:
        if self.table is not None:
            return pin_rows(self.table, self.column)
        if not self.pins:
            return None
        return pin_rows(spark.createDataFrame([(p,) for p in self.pins], "pin string"))

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the bitmap in a reserved column (null: nothing registered)."""
        rows = self.rows(df.sparkSession)
        if rows is None:
            return df.withColumn(PIN_BITS, F.lit(None).cast("array<bigint>"))
        at = F.col("pin").cast("bigint") - _FIRST_PIN
        words = rows.groupBy((at / 64).cast("int").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))).alias("bits"))
        every = df.sparkSession.range(_PIN_WORDS).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
        bitmap = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b"))
        return df.withColumn(PIN_BITS, bitmap.select(F.transform("b", lambda x: x["bits"])).scalar())

    @staticmethod
    def contains(pin: Column) -> Column:
        at = F.when(pin.rlike(PIN_SHAPE), pin.cast("bigint") - _FIRST_PIN)
        word = F.get(F.col(PIN_BITS), (at / 64).cast("int"))
        return F.coalesce(F.getbit(word, (at % 64).cast("int")) == 1, F.lit(False))


# Cheap necessary conditions (a row failing one cannot match that detector).
def _guards(text: Column, has: Column) -> dict[str, Column]:
    """Conditions by detector; ``has`` is :func:`_holds` of the text, evaluated once."""
    digit, at = has["digit"], has["at"]
    return {
        "EMAIL": at,
        "PHONE": digit,
        "PAN": digit,
        "AADHAAR": digit,
        "UPI": at,
        "IP": digit & (F.instr(text, ".") > 0),
        # any match holds 20 consecutive token characters: a look-around-free scan
        "SECRET": text.rlike(r"[A-Za-z0-9_\-]{20}"),
        "LONGNUM": digit,
        "ADDRESS": digit & (F.instr(text, "\n") > 0) & text.rlike(P.JAVA_PIN),
        "SSN": digit & (F.instr(text, "-") > 0),
        "POSTAL_CODE": digit,
    }


def _holds(text: Column) -> Column:
    return F.struct(text.rlike(f"[{P.JAVA_DIGIT_BODY}]").alias("digit"), (F.instr(text, "@") > 0).alias("at"))


# Every ADDRESS match starts with one of the starter words; testing their first
# letters before the form look-ahead keeps that look-ahead off most positions.
_ADDRESS_FIRST = "(?=[FHDPTBSN])"


_FORM_LINES, _FORM_WINDOW = 9, 4096


def _form_at(part, start: Column) -> Column:
    """Whether the labelled form starts at ``start``: it lies in nine lines, which are
    looked for in a window of the text first and in all that follows if that has fewer."""
    form = "^(?:" + P.to_java(P.ADDRESS_FORM_LINE) + ")"

    def nine_lines(text):
        return F.substring_index(text, "\n", _FORM_LINES)

    def test(window):
        near = nine_lines(window)
        return F.when(F.octet_length(near) < F.octet_length(window), near.rlike(form)).otherwise(
            nine_lines(part(start, F.lit(1 << 30))).rlike(form))

    return let(part(start, F.lit(_FORM_WINDOW)), test)


def _address_cands(text: Column, guard: Column, prio: int, keep) -> Column:
    """ADDRESS candidates with the labelled-form look-ahead (V2), exactly.

    The look-ahead scans up to nine lines at every position the grammar is
    tried, which is quadratic on long texts.  Scanning with the body alone gives
    the same matches as long as none of them starts at a blocked position (both
    scans are identical up to the first blocked candidate), so the look-ahead is
    tested only at candidate starts, and only rows holding a blocked candidate
    (labelled forms) are rescanned with the full grammar.
    """
    body = _ADDRESS_FIRST + P.to_java(P.ADDRESS_BODY)
    full = _ADDRESS_FIRST + P.JAVA_DETECTORS["ADDRESS"]

    def cands(t, part):
        def chosen(quick):
            blocked = F.exists(quick, lambda c: _form_at(part, c["start"]))
            found = F.when(blocked, find_cands(t, full, "ADDRESS", prio)).otherwise(quick)
            return found if keep is None else F.filter(found, lambda c: keep(part(c["start"], c["end"] - c["start"])))

        return let(find_cands(t, body, "ADDRESS", prio), chosen)

    return F.when(guard, with_cut(text, cands)).otherwise(empty(CAND_ARRAY))


def detector_cands(text: Column, label: str, raw: bool = False) -> Column:
    """array<candidate> for one detector label; ``raw`` skips the registry test, which
    else needs the column that :meth:`PinRegistry.attach` adds."""
    return all_cands(text, [label], raw)


def all_cands(text: Column, labels: Iterable[str] = P.DETECTOR_ORDER, raw: bool = False) -> Column:
    """Union of the detectors' candidates (P1), one array per row.

    The pieces of all detectors but ADDRESS go through one fold, which keeps the plan
    small: each detector adds its regex and its guard only."""
    labels = list(labels)
    if not labels:
        return empty(CAND_ARRAY)
    return let(_holds(text), lambda has: _all_cands(text, labels, _guards(text, has), raw))


def _all_cands(text: Column, labels: list[str], guards: dict[str, Column], raw: bool) -> Column:
    arrays = []
    if "ADDRESS" in labels:

        def in_registry(match):
            pin = F.regexp_extract(match, P.JAVA_PIN, 0)
            return (pin != "") & PinRegistry.contains(pin)

        arrays.append(_address_cands(text, guards["ADDRESS"], P.DETECTOR_ORDER.index("ADDRESS"), None if raw else in_registry))
    plain = [x for x in labels if x != "ADDRESS"]
    if plain:
        found = F.array(*(
            F.when(guards[x], F.struct(split_on_matches(text, P.JAVA_DETECTORS[x]).alias("pieces"), F.lit(P.DETECTOR_ORDER.index(x)).alias("prio"), F.lit(x).alias("label")))
            for x in plain))
        # one piece is a text without a match
        found = F.filter(found, lambda d: d.isNotNull() & (F.size(d["pieces"]) > 1))

        def cands(d):
            def keep(match):
                return (d["label"] != "POSTAL_CODE") | (F.length(match) != 6) | PinRegistry.contains(match)

            return matches_to_cands(d["pieces"], d["label"], d["prio"], None if raw or "POSTAL_CODE" not in plain else keep)

        arrays.append(F.flatten(F.transform(found, cands)))
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]
