"""Secret scans in SQL functions only: known shapes, and entropy of sliding windows.

Shapes (assign, access, hex) come from regular expressions. The entropy scan takes candidate strings,
slides a window over each and keeps the count of every character: a step adds one character and
removes one, which changes two terms of the sum of c log2 c and so the entropy
log2(w) - sum / w. Character classes differ in alphabet and hence in threshold. A candidate that fits no class or
holds a placeholder is cut at ``=``, ``/`` and ``+``, then at ``_`` and ``-``, and its parts are judged by
themselves, so a value is found beside the name or path that it is glued to. Strings of the
allow list and spans inside a shape's span are suppressed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

_SECRET_NAME = r"(?i:password|passwd|secret|token|api_?key)"


class Shape(NamedTuple):
    """``group`` of ``pattern`` must have ``least`` characters, else the match is dropped (it still
    uses up its text). A pattern that cannot match less needs no such test."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Shapes in order of their kinds. Runs that are too short never match hex and access, as
#: a run is taken whole wherever it starts.
SHAPES = [
    Shape("assign", _SECRET_NAME + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    Shape("access", r"AKIA[A-Z0-9]{14,}"),
    Shape("hex", r"[0-9a-f]{16,}"),
]


class CharClass(NamedTuple):
    """Candidates that match ``candidate`` whole; windows of ``width`` characters are secret from ``bits`` on."""

    name: str
    candidate: str
    width: int
    bits: float


#: Tried in order; a candidate belongs to the first class that it matches.
CLASSES = [
    CharClass("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)$", 20, 3.0),
    CharClass("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 20, 3.8),
    CharClass("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 20, 3.6),
    # letters and digits take turns within a run, as words and numbers joined by marks do not
    CharClass("marked", r"^(?=.*[A-Za-z][0-9]+[A-Za-z]+[0-9])[A-Za-z0-9_-]+$", 20, 3.6),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What a candidate without a verdict is cut to, in turn.
CUTS = [r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}"]
#: Harmless strings, with all their parts: UUIDs, integrity hashes, words joined by marks.
HARMLESS = [r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^sha(256|384|512)-", r"^(?:[A-Za-z]+|[0-9]+)(?:[/_=-]+(?:[A-Za-z]+|[0-9]+))+$"]
#: A string that holds one of these is no secret as a whole; its parts may be.
PLACEHOLDERS = [r"(?i)example|placeholder|x{8}|0{8}|1234567"]
ALLOWED = HARMLESS + PLACEHOLDERS

_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


_HELD = "array<struct<start:bigint,value:string>>"
#: Matches that are folded together; arrays grow once for so many.
FOLD = 512


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once: what stands in a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _state(at: Column, out: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), out.alias("out"))


def _folded(items: Column, kind: str, first: Column, step) -> Column:
    """The array ``out`` after ``step(state, item)`` has taken each item; the state holds a number ``at`` and ``out``."""

    def fold(whole):
        def block(acc, begin):
            return F.aggregate(F.slice(whole, begin + 1, FOLD), _state(acc["at"], _none(kind)), step, lambda one: _state(one["at"], F.concat(acc["out"], one["out"])))

        blocks = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(FOLD))
        return F.aggregate(blocks, _state(first, _none(kind)), block, lambda acc: acc["out"])

    return _let(items, fold)


def _matches(text: Column, pattern: str, keep, span, kind: str = _SPANS, at: Column | None = None, values: Column | None = None) -> Column:
    """Spans of leftmost matches that do not overlap. Matches alternate with what ``split`` leaves, so
    places are running sums of lengths in code points, from ``at`` on; what is dropped costs no space.
    ``keep`` gets the match's entry of ``values`` (the match itself if there are none)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last rest has no match after it
    pairs = F.zip_with(found, found if values is None else values, lambda match, value: F.struct(match.alias("match"), value.alias("value")))
    parts = F.zip_with(F.split(text, pattern, -1), pairs, lambda gap, m: F.struct(gap.alias("gap"), m["match"].alias("match"), m["value"].alias("value")))

    def step(acc, part):
        begin, match = acc["at"] + F.length(part["gap"]), part["match"]
        return _state(begin + F.length(match), F.when(match.isNotNull() & keep(part["value"]), F.concat(acc["out"], F.array(span(begin, match)))).otherwise(acc["out"]))

    return F.when(text.rlike(pattern), _folded(parts, kind, F.lit(0) if at is None else at, step)).otherwise(_none(kind))


def _span(start: Column, stop: Column, kind: str, rank: int) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(rank).cast("int").alias("rank"), stop.cast("bigint").alias("stop"), F.lit(kind).alias("kind"))


def shape_spans(text: Column, shape: Shape, rank: int) -> Column:
    """Array of (start, rank, stop, kind) of one shape; code points, stop exclusive."""
    values = F.regexp_extract_all(text, F.lit(shape.pattern), F.lit(shape.group)) if shape.least and shape.group else None
    keep = (lambda value: F.length(value) >= shape.least) if shape.least else (lambda value: F.lit(True))
    return _matches(text, shape.pattern, keep, lambda begin, match: _span(begin, begin + F.length(match), shape.kind, rank), values=values)


def _term(c: Column) -> Column:
    """c log2 c, 0 for none."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def high_windows(value: Column, width: int, bits: float) -> Column:
    """Struct (first, last) of the offsets that windows of at least ``bits`` of entropy cover in
    ``value`` (last exclusive); nulls if there are none. Counts change by one character a step."""
    return _let(F.split(value, ""), lambda chars: _high_windows(chars, width, bits))


def _high_windows(chars: Column, width: int, bits: float) -> Column:
    letters = F.array_distinct(chars)
    start = F.struct(F.map_from_arrays(letters, F.transform(letters, lambda _: F.lit(0))).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc, i):
        new, old = F.get(chars, i), F.when(i >= width, F.get(chars, i - width)).otherwise(F.lit(""))
        grown = F.element_at(acc["counts"], new)
        shrunk = F.coalesce(F.element_at(acc["counts"], old), F.lit(0))
        same = new == old
        total = F.when(same, acc["total"]).otherwise(acc["total"] + _term(grown + 1) - _term(grown) + F.when(old != "", _term(shrunk - 1) - _term(shrunk)).otherwise(0.0))
        counts = F.transform_values(acc["counts"], lambda k, v: v + (k == new).cast("int") - (k == old).cast("int"))
        high = (i >= width - 1) & (F.log2(F.lit(float(width))) - total / width >= bits - 1e-9)
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(high, F.coalesce(acc["first"], i - (width - 1))).otherwise(acc["first"]).alias("first"),
                        F.when(high, i + 1).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _strings(text: Column, pattern: str, at: Column) -> Column:
    """Array of (start, value) of the matches; ``at`` is the place of the text's first character."""
    return _matches(text, pattern, lambda _: F.lit(True), lambda begin, match: F.struct(begin.cast("bigint").alias("start"), match.alias("value")), _HELD, at)


def _fits(value: Column, patterns: list[str]) -> Column:
    return value.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _judged(strings: Column, cuts: list[str]) -> Column:
    """The strings, or parts of them, whose entropy counts."""

    def one(c):
        v = c["value"]
        whole = F.greatest(*[v.rlike(k.candidate) for k in CLASSES]) & ~_fits(v, PLACEHOLDERS)
        parts = _judged(_strings(v, cuts[0], c["start"]), cuts[1:]) if cuts else _none(_HELD)
        return F.when(_fits(v, HARMLESS), _none(_HELD)).when(whole, F.array(c)).otherwise(parts)

    return F.flatten(F.transform(strings, one))


def entropy_spans(text: Column, rank: int) -> Column:
    """Spans of candidates' high-entropy windows, one for each string that has any: a candidate, or
    the parts of one that has no verdict as a whole."""

    def scan(c):
        one = None
        for k in CLASSES:
            w = high_windows(c["value"], k.width, k.bits)
            one = F.when(c["value"].rlike(k.candidate), w) if one is None else one.when(c["value"].rlike(k.candidate), w)
        return F.struct(c["start"].alias("start"), one.alias("w"))

    scanned = F.filter(F.transform(_judged(_strings(text, CANDIDATE, F.lit(0)), CUTS), scan), lambda c: c["w"]["first"].isNotNull())
    spans = F.transform(scanned, lambda c: _span(c["start"] + c["w"]["first"], c["start"] + c["w"]["last"], "entropy", rank))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(_none())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``docs`` with two more columns: spans of the shapes, and those plus the entropy scan's, each an
    array of (start, rank, stop, kind) by start and kind. A null text counts as empty and has
    none. Every row is worked on by itself; nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[shape_spans(text, s, k) for k, s in enumerate(SHAPES)]))
    with_base = docs.withColumn(base_col, base)
    new = entropy_spans(text, len(SHAPES))

    def step(acc, s):
        # at: how far the shapes' spans so far reach
        shape = s["rank"] < len(SHAPES)
        return _state(F.when(shape, F.greatest(acc["at"], s["stop"])).otherwise(acc["at"]), F.when(shape | (s["stop"] > acc["at"]), F.concat(acc["out"], F.array(s))).otherwise(acc["out"]))

    return with_base.withColumn(spans_col, _folded(F.array_sort(F.concat(F.col(base_col), new)), _SPANS, F.lit(0), step))


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; spans are written
    ``kind:start:end`` and joined by commas."""
    found = secret_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(s.kind).alias(f"n_{s.kind}") for s in SHAPES], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
