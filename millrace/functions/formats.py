"""Composite, number and date format strings compiled to Spark expressions.

The format text is parsed once on the driver; the result is a plain column built from built-in functions.
An unsupported specifier raises :class:`UnsupportedFormat`, so the caller decides on the fallback.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from millrace.functions.columns import INTEGRAL, NUMERIC, TEMPORAL, as_text


class UnsupportedFormat(ValueError):
    pass


# Date tokens and their java.time letters.
DATE_TOKENS = {
    "yyyy": "yyyy", "yy": "yy",
    "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M",
    "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h",
    "mm": "mm", "m": "m", "ss": "ss", "s": "s",
    "fffffff": "SSSSSSS", "ffffff": "SSSSSS", "fffff": "SSSSS", "ffff": "SSSS",
    "fff": "SSS", "ff": "SS", "f": "S",
    "tt": "a", "zzz": "xxx", "K": "XXX",
}

# Single-letter standard date formats (invariant culture).
STANDARD_DATES = {
    "d": "MM/dd/yyyy",
    "D": "dddd, dd MMMM yyyy",
    "t": "HH:mm",
    "T": "HH:mm:ss",
    "f": "dddd, dd MMMM yyyy HH:mm",
    "F": "dddd, dd MMMM yyyy HH:mm:ss",
    "g": "MM/dd/yyyy HH:mm",
    "G": "MM/dd/yyyy HH:mm:ss",
    "M": "MMMM dd",
    "m": "MMMM dd",
    "Y": "yyyy MMMM",
    "y": "yyyy MMMM",
    "s": "yyyy-MM-dd'T'HH:mm:ss",
    "u": "yyyy-MM-dd HH:mm:ss'Z'",
    "o": "yyyy-MM-dd'T'HH:mm:ss.fffffff",
    "O": "yyyy-MM-dd'T'HH:mm:ss.fffffff",
}

_DATE_PART = re.compile(r"'([^']*)'|\"([^\"]*)\"|\\(.)|([A-Za-z])\4*|(.)", re.DOTALL)


def date_pattern(spec: str) -> str:
    """Java date pattern for a date format string."""
    spec = STANDARD_DATES.get(spec, spec)
    out = []
    for match in _DATE_PART.finditer(spec):
        text = match.group(0)
        if match.group(4):
            if text not in DATE_TOKENS:
                raise UnsupportedFormat(f"date token {text!r} in {spec!r}")
            out.append(DATE_TOKENS[text])
            continue
        literal = next(g for g in (match.group(1), match.group(2), match.group(3), match.group(5)) if g is not None)
        out.append("''" if literal == "'" else f"'{literal}'" if literal else "")
    return "".join(out)


def format_date(value: Column, spec: str) -> Column:
    return F.date_format(value, date_pattern(spec))


def parse_timestamp(text: Column) -> Column:
    """Timestamp from ISO text or the month-first form; null where neither parses."""
    return F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
    )


_SCALE = 12  # digits kept beyond the point, or as many as the format asks for


def _decimal(value: Column, digits: int) -> Column:
    """Half-up rounding on the printed digits (not on the binary expansion); null where 38 digits do not hold it."""
    return F.round(value.try_cast(f"decimal(38,{max(_SCALE, min(digits, 37))})"), digits)


def _fixed(value: Column, digits: int, grouped: bool, factor: int = 1) -> Column:
    """Digits with a fixed number of decimals; what a decimal cannot hold is printed from the double."""
    wide = F.format_string(f"%{',' if grouped else ''}.{digits}f", value.cast("double") * factor)
    if digits > 37:
        return wide
    exact = F.round(value.try_cast(f"decimal(38,{max(_SCALE, digits)})") * factor, digits) if factor != 1 else _decimal(value, digits)
    text = F.format_number(exact, digits) if grouped else exact.cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(text, wide)


def _standard_number(value: Column, dtype: T.DataType, letter: str, digits: int | None) -> Column:
    two = 2 if digits is None else digits
    if letter == "F":
        return _fixed(value, two, False)
    if letter == "N":
        return _fixed(value, two, True)
    if letter == "P":
        return F.concat(_fixed(value, two, True, 100), F.lit(" %"))
    if letter == "C":
        text = _fixed(F.abs(value), two, True)
        return F.when(value < 0, F.concat(F.lit("(¤"), text, F.lit(")"))).otherwise(F.concat(F.lit("¤"), text))
    if letter == "E":
        six = 6 if digits is None else digits
        return F.regexp_replace(F.format_string(f"%.{six}E", value.cast("double")), r"E([+-])(\d\d)$", "E$10$2")
    if letter == "G" and not digits:
        return as_text(value, dtype)
    if letter in "DX" and isinstance(dtype, INTEGRAL):
        if letter == "X":
            text = F.hex(value.cast("bigint"))
            return F.when(F.length(text) >= (digits or 0), text).otherwise(F.lpad(text, digits or 0, "0"))
        text = F.abs(value.cast("decimal(20,0)")).cast("string")
        padded = F.when(F.length(text) >= (digits or 0), text).otherwise(F.lpad(text, digits or 0, "0"))
        return F.when(value < 0, F.concat(F.lit("-"), padded)).otherwise(padded)
    raise UnsupportedFormat(f"number format {letter}{digits if digits is not None else ''} for {dtype.simpleString()}")


_CUSTOM_NUMBER = re.compile(r"^(?P<head>[^#0.,%]*)(?P<whole>[#0,]+)(?:\.(?P<frac>[0#]+))?(?P<tail>[^#0.,]*)$")


def _custom_number(value: Column, spec: str) -> Column:
    match = _CUSTOM_NUMBER.match(spec)
    if not match or ";" in spec:
        raise UnsupportedFormat(f"number format {spec!r}")
    head, whole, frac, tail = match["head"], match["whole"], match["frac"] or "", match["tail"]
    if "%" in tail:
        value = value.try_cast("decimal(38,12)") * 100
    grouped = "," in whole
    zeros = whole.count("0")
    rounded = _decimal(value, len(frac))
    text = F.format_number(F.abs(rounded), len(frac))
    if not grouped:
        text = F.replace(text, F.lit(","), F.lit(""))
    for _ in range(len(frac) - len(frac.rstrip("#"))):
        text = F.regexp_replace(text, r"(\.\d*)0$", "$1")
    if frac and "0" not in frac:
        text = F.regexp_replace(text, r"\.$", "")
    if zeros == 0:
        text = F.regexp_replace(text, r"^0(?=\.|$)", "")
    elif zeros > 1 and not grouped:
        width = zeros + (len(frac) + 1 if frac else 0)
        text = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    signed = F.when(rounded < 0, F.concat(F.lit("-"), F.lit(head), text)).otherwise(F.concat(F.lit(head), text))
    return F.concat(signed, F.lit(tail)) if tail else signed


def format_numeric(value: Column, dtype: T.DataType, spec: str) -> Column:
    """Text of a number under a standard (``F2``, ``N0``, ``D5``…) or custom (``#,##0.00``) format."""
    standard = re.fullmatch(r"([A-Za-z])(\d{0,2})", spec)
    if standard:
        return _standard_number(value, dtype, standard[1].upper(), int(standard[2]) if standard[2] else None)
    return F.coalesce(_custom_number(value, spec), as_text(value, dtype))


_HOLE = re.compile(r"\{\{|\}\}|\{(\d+)(?:,(-?\d+))?(?::([^{}]*))?\}|[{}]|[^{}]+")


def composite(value: Column, dtype: T.DataType, template: str) -> Column:
    """Text of ``template`` with ``{0[,align][:spec]}`` replaced by the value."""
    parts: list[Column] = []
    for match in _HOLE.finditer(template):
        text = match.group(0)
        if text in ("{{", "}}"):
            parts.append(F.lit(text[0]))
        elif match.group(1) is not None:
            if match.group(1) != "0":
                raise UnsupportedFormat(f"argument {match.group(1)} in {template!r}")
            hole = _hole(value, dtype, match.group(3))
            width = int(match.group(2) or 0)
            if width:
                pad = F.lpad if width > 0 else F.rpad
                hole = F.when(F.length(hole) >= abs(width), hole).otherwise(pad(hole, abs(width), " "))
            parts.append(hole)
        elif text in "{}":
            raise UnsupportedFormat(f"stray brace in {template!r}")
        else:
            parts.append(F.lit(text))
    return F.concat(*parts) if parts else F.lit("")


def _hole(value: Column, dtype: T.DataType, spec: str | None) -> Column:
    if not spec:
        return as_text(value, dtype)
    if isinstance(dtype, NUMERIC):
        return format_numeric(value, dtype, spec)
    if isinstance(dtype, TEMPORAL):
        return format_date(value, spec)
    return as_text(value, dtype)  # text and booleans ignore the specifier

