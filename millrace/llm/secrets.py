"""Secrets in texts, found with DataFrame functions alone.

Base kinds (assign, access, hex) are kept whenever their own lengths hold. The added kinds are candidate strings, runs of
one character class, in which some window of fixed width has a Shannon entropy of at least the class's threshold. Counts
of the window's characters, and their sum of n * log2(n), are kept up as it slides: one count rises, one falls. Strings on
the allow-list, such as plain words, are not reported. Added kinds are sought in what the base spans, and the added kinds
before them, leave (their characters count as blanks), so they overlap nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, as kind -> (what precedes the value, the value, its least length)
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?", r"[A-Za-z0-9+/_.=-]+", 6),
    "access": (r"", r"AKIA[A-Z0-9]+", 20),
    "hex": (r"", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24),  # a shorter run would be dropped
}
RUN = 20  # every base value but that of assign has so many characters from + to z in a row


class Entropy(NamedTuple):
    """A character class: strings of it (``characters``, ASCII from + to z) with ``window`` characters or more are
    candidates; ``bits`` is the entropy that one window must reach, at most log2(window)."""

    kind: str
    characters: str
    window: int
    bits: float


CLASSES = (Entropy("entropy_hex", "0-9A-Fa-f", 24, 3.0), Entropy("entropy_base64", "A-Za-z0-9+/_-", 20, 3.7))

#: Whole candidates that are not reported: words and names of words, numbers, UUIDs, alphabets and stated examples.
ALLOWED = (r"[A-Za-z]+(?:[-_/+][A-Za-z]*)*", r"[0-9]+", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
           r"(?i).*(?:0123456789|abcdefghij|example|placeholder|changeme).*")

SCALE = 1 << 20        # n * log2(n) is summed as integers, so a sum that slides back is the same again
FIRST, LAST = 43, 122  # codes of + and z
BLOCK = 512            # running sums are made in blocks of so many


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _running_sums(numbers: Column) -> Column:
    """Running sums of an array of longs. An array that grows by appending is copied each time, so only blocks of BLOCK
    numbers grow, and the list of their totals."""
    zero = F.array(F.lit(0).cast("long"))

    def grown(parts: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(parts, zero, lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + value(x)))

    def joined(blocks: Column) -> Column:
        return _let(F.struct(blocks.alias("blocks"), grown(blocks, lambda b: F.element_at(b, -1)).alias("starts")),
                    lambda s: F.flatten(F.transform(s["blocks"], lambda b, i: F.transform(
                        F.slice(b, 2, F.lit(BLOCK)), lambda x: x + F.get(s["starts"], i)))))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_)), F.lit(BLOCK)),
                           lambda at: grown(F.slice(all_, at, F.lit(BLOCK)), lambda x: x))

    return _let(numbers, lambda all_: _let(cut(all_), joined))


def _sums(window: int) -> list[int]:
    """What the n-th equal character of a window adds to its sum of n * log2(n); one enters before another leaves."""
    at = [0, *(round(n * log2(n) * SCALE) for n in range(1, window + 2))]
    return [b - a for a, b in zip(at, at[1:])]


def peak_entropy(value: Column, window: int) -> Column:
    """The largest entropy, in bits, of any ``window`` neighbouring characters (codes FIRST to LAST); null if there are
    fewer. Counts are the characters of a short string, one for each code."""
    steps = F.array(*[F.lit(n).cast("long") for n in _sums(window)])
    none, zero = F.lit("0" * (LAST - FIRST + 1)), ord("0")

    def place(codes: Column, i: Column) -> Column:
        return F.ascii(F.substring(codes, i, F.lit(1)).cast("string")) - (FIRST - 1)

    def changed(counts: Column, at: Column, by: int) -> Column:
        """The counts after the change, and the larger of the count before and after it."""
        return _let(F.ascii(F.substring(counts, at, F.lit(1))) - zero, lambda n: F.struct(
            F.overlay(counts, F.char(n + zero + by), at, F.lit(1)).alias("counts"), (n + max(by, 0)).alias("n")))

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            full = i > window
            entered = changed(state["counts"], place(codes, i), 1)

            def left(new: Column) -> Column:
                old = F.when(full, changed(new["counts"], place(codes, i - window), -1))
                return _let(old, lambda gone: _let(
                    state["sum"] + F.element_at(steps, new["n"]) - F.when(full, F.element_at(steps, gone["n"])).otherwise(F.lit(0).cast("long")),
                    lambda total: F.struct(F.coalesce(gone["counts"], new["counts"]).alias("counts"), total.alias("sum"),
                                           F.when(i >= window, F.least(state["least"], total)).alias("least"))))

            return _let(entered, left)

        start = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.length(codes)), start, step)["least"]

    least = F.when(F.length(value) >= window, _let(F.encode(value, "UTF-8"), slide))
    return F.lit(log2(window)) - least / F.lit(float(window * SCALE))


def _pieces(text: Column, may: Column, head: str, value: str, judge: Callable[[Column], Column]) -> Column:
    """A text taken apart: an array of gap, match, kept, entropy that joins to the whole text; null without a match, or
    where it cannot have one (``may`` is false).

    One pattern matches gap, head and value again and again; at the end of the text it matches with an empty value, so
    no search runs to the end in vain. ``judge`` gives of a value the struct of ``kept`` and ``entropy``.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({head})({value})|\z)")
    parts = F.struct(*[F.regexp_extract_all(text, whole, F.lit(i + 1)).alias(n) for i, n in enumerate(("gap", "head", "value"))])

    def piece(p: Column) -> Column:
        return F.transform(p["gap"], lambda gap, i: F.struct(
            gap.alias("gap"), F.concat(F.get(p["head"], i), F.get(p["value"], i)).alias("match"),
            judge(F.get(p["value"], i)).alias("judged")))

    return F.when(may & text.rlike(f"{head}{value}"), _let(parts, piece))


def _ends(pieces: Column) -> Column:
    """Where the match of each piece ends."""
    return _running_sums(F.transform(pieces, lambda p: (F.char_length(p["gap"]) + F.char_length(p["match"])).cast("long")))


def _spans(pieces: Column, ends: Column, kind: str) -> Column:
    """The kept matches: an array of kind, start, end, entropy; empty for a null."""
    placed = F.transform(F.arrays_zip(pieces.alias("p"), ends.alias("end")), lambda z: F.struct(
        F.lit(kind).alias("kind"), (z["end"] - F.char_length(z["p"]["match"])).alias("start"), z["end"].alias("end"),
        z["p"]["judged"]["entropy"].alias("entropy"), z["p"]["judged"]["kept"].alias("kept")))
    kept = F.transform(F.filter(placed, lambda s: s["kept"]), lambda s: F.struct(*[s[f].alias(f) for f in FIELDS]))
    return F.coalesce(kept, F.array().cast(SPANS))


def _rest(text: Column, pieces: Column) -> Column:
    """The text with its kept matches blanked."""
    blanked = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.when(
        p["judged"]["kept"], F.repeat(F.lit(" "), F.char_length(p["match"]))).otherwise(p["match"]))), "")
    return F.coalesce(blanked, text)


FIELDS = ("kind", "start", "end", "entropy")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,entropy:double>>"


def find_secrets(df: DataFrame, text: str = "text", into: str = "spans", classes: Sequence[Entropy] = CLASSES,
                 allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Add the spans of every whole text, by start, then kind as listed: an array of kind, start, end, and entropy (null
    for base kinds, else the largest of a window).

    Null and empty texts have none; equal rows have equal spans; an empty table gives an empty one. A column ``into`` is
    replaced, all others stay. No row is moved.
    """
    kinds = [*BASE, *(c.kind for c in classes)]
    harmless = rf"\A(?:{'|'.join(allowed) or '(?!)'})\z"
    mark = "__secrets"  # begins the names of working columns; longer than any name of the table that begins so
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"

    def long_enough(least: int) -> Callable[[Column], Column]:
        return lambda v: F.struct((F.char_length(v) >= least).alias("kept"), F.lit(None).cast("double").alias("entropy"))

    def entropic(c: Entropy) -> Callable[[Column], Column]:
        return lambda v: _let(F.when(~v.rlike(harmless), peak_entropy(v, c.window)), lambda bits: F.struct(
            F.coalesce(bits >= c.bits, F.lit(False)).alias("kept"), bits.alias("entropy")))

    def column(name: str) -> Column:
        return F.col(mark + name)

    rules = {kind: (head, value, long_enough(least)) for kind, (head, value, least) in BASE.items()}
    rules |= {c.kind: ("", rf"(?<![{c.characters}])[{c.characters}]{{{c.window},}}+", entropic(c)) for c in classes}
    run = rf"(?<![{chr(FIRST)}-{chr(LAST)}])[{chr(FIRST)}-{chr(LAST)}]{{{min([RUN, *(c.window for c in classes)])}}}"
    rows = df.withColumn(f"{mark}text", F.coalesce(F.col(f"`{text}`"), F.lit(""))) \
        .withColumn(f"{mark}run", column("text").rlike(run))
    rest, spans = "text", []
    for i, (kind, rule) in enumerate(rules.items()):
        source = "text" if kind in BASE else rest
        may = column(source).contains("=") | column(source).contains(":") if kind == "assign" else column("run")
        rows = rows.withColumn(f"{mark}p{i}", _pieces(column(source), may, *rule))
        rows = rows.withColumn(f"{mark}e{i}", _ends(column(f"p{i}")))
        rows = rows.withColumn(f"{mark}s{i}", _spans(column(f"p{i}"), column(f"e{i}"), kind))
        spans.append(column(f"s{i}"))
        blank = f"p{i}"
        if source != rest:  # blanked by the kinds before, which leaves no match where there was none
            blank = f"b{i}"
            rows = rows.withColumn(f"{mark}b{i}", _pieces(column(rest), column(f"p{i}").isNotNull(), *rule))
        rows = rows.withColumn(f"{mark}r{i}", _rest(column(rest), column(blank)))
        rest = f"r{i}"
    found = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit(kinds), s["kind"]).cast("int").alias("rank"), s["end"].alias("end"),
        s["entropy"].alias("entropy"))))
    named = F.transform(found, lambda s: F.struct(
        F.element_at(F.lit(kinds), s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["entropy"].alias("entropy")))
    return rows.withColumn(into, named).select(*[f"`{c}`" for c in df.columns if c.lower() != into.lower()], f"`{into}`")
