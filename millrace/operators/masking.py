"""Deterministic masking and sensitive-data detection.

Every mask is a function of the value and a secret (a keyed SHA-256), never of chance: reruns agree and masked
keys still join. Nulls stay null.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field as dc_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import NUMERIC, as_text, called, field

MASK_TYPES = ("Redact", "PartialMask", "Tokenize", "Randomize", "Hash", "DateShift", "NumberVariance", "Custom")
KEYED = ("Tokenize", "Randomize", "Hash", "DateShift", "NumberVariance")


@dataclass(frozen=True)
class Mask:
    type: str
    params: dict = dc_field(default_factory=dict)


def digest(text: Column, secret: str) -> Column:
    return F.sha2(F.concat(F.lit(secret), text), 256)


def hash_number(text: Column, secret: str) -> Column:
    """Number in [0, 2^32) from the first eight hex digits of the keyed digest."""
    return F.conv(F.substring(digest(text, secret), 1, 8), 16, 10).cast("bigint")


def _partial(text: Column, start: int, end: int, char: str) -> Column:
    length = F.length(text)
    shown = F.concat(F.substring(text, 1, start), F.repeat(F.lit(char), (length - start - end).cast("int")),
                     F.right(text, F.lit(end)) if end else F.lit(""))
    return F.when(length <= start + end, F.repeat(F.lit(char), length)).otherwise(shown)


def _letters(first: str, last: str) -> str:
    return "".join(chr(c) for c in range(ord(first), ord(last) + 1) if chr(c).isalnum())


#: Characters are replaced within their class; those of no class stay.
CLASSES = tuple(_letters(*ends) for ends in ("az", "AZ", "09", "ßÿ", "ÀÞ", "Āſ", "αω", "ΑΩ", "ая", "АЯ"))
ROUNDS = 4
#: Bytes of text that are worked on at a time; a longer text is one piece.
CHUNK = 1 << 18


def _tokenize(text: Column, secret: str, preserve_length: bool, preserve_format: bool) -> Column:
    if preserve_format:
        return _permuted(text, secret)
    hashed = digest(text, secret)
    if preserve_length:
        return F.substring(F.repeat(hashed, F.ceil(F.length(text) / 64).cast("int")), F.lit(1), F.length(text))
    return hashed


def _permuted(text: Column, secret: str) -> Column:
    """Another text of the same length and the same class at every place; no two texts have the same.

    Feistel rounds: the characters at even places turn within their classes by a keyed digest of those at odd places, then
    the reverse. Each round can be undone, since what it depends on is still there, so all rounds are a permutation. A
    round is one digest of each text and one pass over the characters of many texts at a time.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        # bytes that are no UTF-8 are kept as characters of no class
        plain = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        out, rows, size = [], [], 0
        for value in plain:
            value = value.as_py()
            rows.append(value if value is None else value.decode("utf-8", "surrogateescape"))
            size += len(value or b"")
            if size > CHUNK:
                out += _turned(rows, secret)
                rows, size = [], 0
        return pa.array(out + _turned(rows, secret), plain.type).view(texts.type)

    return run(text)


def _places() -> tuple[np.ndarray, ...]:
    """Of each code point up to the last of a class: where its class begins in all letters, its place there and the size of
    the class, 0 if it has none. Then all letters."""
    letters = "".join(CLASSES)
    first, place, size = np.zeros((3, max(map(ord, letters)) + 2), np.int32)
    for k in CLASSES:
        codes = [ord(c) for c in k]
        first[codes], place[codes], size[codes] = letters.index(k), range(len(k)), len(k)
    return first, place, size, np.array([ord(c) for c in letters], np.uint32)


_FIRST, _PLACE, _SIZE, _LETTERS = _places()


def _turned(texts: list[str | None], secret: str) -> list[bytes | None]:
    """All rounds on some texts, whose characters lie in one array."""
    whole = [t for t in texts if t is not None]
    chars = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.array([len(t) for t in whole], np.int64)
    row = np.repeat(np.arange(len(whole)), lengths)
    at = np.arange(len(chars)) - (np.cumsum(lengths) - lengths)[row]
    code = np.minimum(chars, len(_SIZE) - 1)
    first, place, size = _FIRST[code], _PLACE[code], _SIZE[code]
    odd = at % 2 == 1
    movable = [np.flatnonzero((odd == turned) & (size > 0)) for turned in (False, True)]
    for number in range(ROUNDS):
        turned, at_odd = movable[number % 2], number % 2 == 1
        others = chars[odd != at_odd]
        data, ends = _utf8(others, np.cumsum((lengths + 1) // 2 if at_odd else lengths // 2))
        key, begin, digests = hashlib.sha256(f"{secret}|{number}|".encode()), 0, []
        for end in ends:
            hashed = key.copy()
            hashed.update(data[begin:end])
            digests.append(hashed.digest())
            begin = end
        by = np.frombuffer(b"".join(digests), np.uint8)[row[turned] * 32 + at[turned] % 32]
        place[turned] = (place[turned] + by) % size[turned]
        chars[turned] = _LETTERS[first[turned] + place[turned]]
    data, ends = _utf8(chars, np.cumsum(lengths))
    made = (bytes(data[b:e]) for b, e in zip([0, *ends], ends))
    return [None if t is None else next(made) for t in texts]


def _utf8(chars: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """Characters as UTF-8, and where the bytes of each text end."""
    wide = 1 + (chars >= 0x80) + (chars >= 0x800).astype(np.int64) + (chars >= 0x10000)
    wide[(chars >= 0xDC80) & (chars <= 0xDCFF)] = 1  # a byte that was no UTF-8
    data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
    return memoryview(data), np.concatenate([[0], np.cumsum(wide)])[ends].tolist()


def mask_column(df: DataFrame, name: str, mask: Mask) -> Column:
    """Masked value of one column."""
    p = mask.params
    dtype = df.schema[name].dataType
    value, text = field(name), as_text(field(name), dtype)
    if mask.type in KEYED and not p.get("salt"):
        raise ValueError(f"{mask.type} needs a secret: the parameter salt")
    secret = str(p.get("salt", ""))
    if mask.type == "Redact":
        return F.when(value.isNotNull(), F.lit(p.get("replacement", "[REDACTED]")))
    if mask.type == "PartialMask":
        return _partial(text, int(p.get("start", 0)), int(p.get("end", 0)), p.get("char", "*"))
    if mask.type == "Tokenize":
        return _tokenize(text, secret, bool(p.get("preserveLength", True)), bool(p.get("preserveFormat", True)))
    if mask.type == "Randomize":
        domain = p.get("domain")
        if not domain:
            return digest(text, secret)
        choice = (hash_number(text, secret) % len(domain)).cast("int")
        return F.get(F.array(*[F.lit(d) for d in domain]), choice)
    if mask.type == "Hash":
        hashed = digest(text, secret)
        if not p.get("preserveLength"):
            return hashed
        return F.substring(F.repeat(hashed, F.ceil(F.length(text) / 64).cast("int")), F.lit(1), F.length(text))
    if mask.type == "DateShift":
        return _date_shift(df, name, value, dtype, p, secret)
    if mask.type == "NumberVariance":
        return _variance(value, dtype, text, p, secret)
    if mask.type == "Custom":
        return called(p["call"], [value], p.get("returns", "string")) if p.get("call") else F.expr(p["expression"])
    raise ValueError(f"unknown mask {mask.type!r}")


def _date_shift(df: DataFrame, name: str, value: Column, dtype: T.DataType, p: dict, secret: str) -> Column:
    """Shift by days taken from the entity key, so all dates of an entity move together."""
    low, high = int(p.get("min", -30)), int(p.get("max", 30))
    key = p.get("key", name)
    seed = hash_number(as_text(field(key), df.schema[key].dataType), secret)
    if p.get("preserveDay"):
        first, last = -(-low // 7), high // 7
        days = (F.lit(first) + seed % (last - first + 1)) * 7
    else:
        days = F.lit(low) + seed % (high - low + 1)
    days = F.coalesce(days, F.lit(low)).cast("int")
    if isinstance(dtype, T.DateType):
        return F.date_add(value, days)
    return value + F.make_dt_interval(days)


def _variance(value: Column, dtype: T.DataType, text: Column, p: dict, secret: str) -> Column:
    """v·(1 + p/100) with p spread over [min, max] percent in steps of 1/100 000 of the span."""
    low, high = float(p.get("min", -10)), float(p.get("max", 10))
    share = (hash_number(text, secret) % 100001).cast("double") / 100000.0
    if not isinstance(dtype, NUMERIC):
        value = value.try_cast("double")
    moved = value.cast("double") * (1 + (low + share * (high - low)) / 100)
    return moved.cast(dtype) if isinstance(dtype, T.DecimalType) else moved


def mask_data(df: DataFrame, masks: dict[str, Mask]) -> DataFrame:
    """Mask the named columns in one projection; unknown columns are ignored."""
    masks = {n: m if isinstance(m, Mask) else Mask(**m) for n, m in masks.items()}
    return df.select(*[mask_column(df, c, masks[c]).alias(c) if c in masks else field(c) for c in df.columns])


@dataclass(frozen=True)
class MaskingProfile:
    name: str
    masks: dict[str, Mask]
    description: str = ""


def mask_with_profile(df: DataFrame, profile: MaskingProfile) -> DataFrame:
    return mask_data(df, profile.masks)


# -- detection --------------------------------------------------------------------------------------------------

# Value patterns (kept to syntax shared by Java and RE2).
VALUE_PATTERNS = {
    "EmailAddress": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "PhoneNumber": r"(^|[^0-9])(\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}($|[^0-9])",
    "SocialSecurityNumber": r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9-])",
    "IpAddress": r"(^|[^0-9.])((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])($|[^0-9.])",
}
CARD_PATTERN = r"([0-9](?:[ -]?[0-9]){12,18})"

# Parts of column names that point at a kind of data.
NAME_HINTS = {
    "PersonName": r"(first|last|full|person|customer|sur)_?name|^name$",
    "Address": r"address|street|city|postal|zip",
    "Password": r"passw|pwd|secret",
    "DateOfBirth": r"birth|dob",
    "FinancialData": r"acctbal|balance|salary|iban|account|price|income",
    "HealthData": r"health|diagnos|medic|patient",
    "EmailAddress": r"e?mail",
    "PhoneNumber": r"phone|mobile",
    "CreditCardNumber": r"card",
    "SocialSecurityNumber": r"ssn|social_security",
    "IpAddress": r"(^|_)ip(_|$)|ip_?address",
}

# The mask suggested for each kind of data.
SUGGESTED = {
    "PersonName": "Tokenize", "EmailAddress": "Tokenize", "PhoneNumber": "PartialMask", "Address": "Redact",
    "CreditCardNumber": "PartialMask", "SocialSecurityNumber": "PartialMask", "IpAddress": "Hash",
    "Password": "Redact", "DateOfBirth": "DateShift", "FinancialData": "NumberVariance", "HealthData": "Redact",
    "Custom": "Custom",
}
TYPES = tuple(SUGGESTED)
HIT_RATE = 0.8


def has_card(text: Column) -> Column:
    """True where the text holds a run of 13 to 19 digits that passes the Luhn check."""
    runs = F.regexp_extract_all(text, F.lit(CARD_PATTERN), F.lit(1))
    return F.exists(runs, lambda r: F.call_function("luhn_check", F.regexp_replace(r, "[ -]", "")))


def _with_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add two cheap flags per text column, so that the costly patterns run only where they can match."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.select("*", *[field(c).contains("@").alias(f"__at_{c}") for c in texts],
                     *[field(c).rlike("[0-9]").alias(f"__digit_{c}") for c in texts])


def value_tests(name: str, types: list[str] | None = None, custom: str | None = None) -> dict[str, Column]:
    """Boolean column per kind of data for a text column of a frame with flags."""
    text, at, digit = field(name), field(f"__at_{name}"), field(f"__digit_{name}")
    tests = {kind: (at if kind == "EmailAddress" else digit) & text.rlike(pattern)
             for kind, pattern in VALUE_PATTERNS.items()}
    tests["CreditCardNumber"] = digit & has_card(text)
    if custom:
        tests["Custom"] = text.rlike(custom)
    return {n: t for n, t in tests.items() if types is None or n in types}


def name_hints(name: str, types: list[str] | None = None) -> list[str]:
    return [n for n, pattern in NAME_HINTS.items()
            if (types is None or n in types) and re.search(pattern, name.lower())]


def detect(df: DataFrame, types: list[str] | None = None, columns: list[str] | None = None,
           custom: str | None = None, target: str = "sensitive") -> DataFrame:
    """Rows with ``array<struct<column,type>>``: value patterns on text columns, name hints on any non-null value."""
    found, names = [], df.columns
    for name in columns or names:
        value = field(name)
        hinted = name_hints(name, types)
        tests = value_tests(name, types, custom) if isinstance(df.schema[name].dataType, T.StringType) else {}
        for kind in TYPES:
            if kind in hinted:
                test = value.isNotNull()
            elif kind in tests:
                test = F.coalesce(tests[kind], F.lit(False))
            else:
                continue
            found.append(F.when(test, F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"))))
    if not found:
        return df.withColumn(target, F.array().cast("array<struct<column:string,type:string>>"))
    tags = F.filter(F.array(*found), lambda t: t.isNotNull()).alias(target)
    return _with_flags(df, columns or names).select(*[field(c) for c in names], tags)


def suggest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, type, mask, hit_rate: the best kind per column with a hit rate of at least 0.8, or a name hint."""
    described = []
    for name in columns or df.columns:
        value = field(name)
        hinted = name_hints(name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        rates = {k: F.try_divide(F.count_if(t), F.count(value)) for k, t in value_tests(name).items()} if is_text else {}
        candidates = []
        for kind in TYPES:
            if kind not in hinted and kind not in rates:
                continue
            rate = F.coalesce(rates.get(kind, F.lit(0.0)), F.lit(0.0))
            chosen = F.lit(True) if kind in hinted else rate >= HIT_RATE
            candidates.append(F.when(chosen, F.struct(
                rate.alias("hit_rate"), F.lit(-TYPES.index(kind)).alias("place"), F.lit(kind).alias("type"),
                F.lit(SUGGESTED[kind]).alias("mask"))))
        if candidates:
            best = F.array_max(F.filter(F.array(*candidates), lambda c: c.isNotNull()))
            described.append(F.struct(F.lit(name).alias("column"), best["type"].alias("type"),
                                      best["mask"].alias("mask"), best["hit_rate"].alias("hit_rate")))
    flagged = _with_flags(df, columns or df.columns)
    return flagged.agg(F.array(*described).alias("rows")).select(F.inline("rows")).filter(F.col("type").isNotNull())
