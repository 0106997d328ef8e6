"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Base kinds (email, ip, card, phone) are kept whenever their own checks hold. The added kinds (iban, ssn, tel, and access and
secret for keys to accounts) need a score of at least ``LEAST``, which a number alone reaches only by a checksum; otherwise
words before it must name it.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import DataFrame

from millrace.llm.frames import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "access", "secret")
LEAST = 0.6
REACH = 40  # code points before a span that are searched for context words

# The base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # each run of digits is tried once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_COUNTRIES = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
              22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
              25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
              29: "BR EG PS QA UA", 30: "JO MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_LENGTHS = {country: length for length, countries in _COUNTRIES.items() for country in countries.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])")
_DIGIT = re.compile(r"[0-9]")
_ACCESS = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16,}")
_SECRET = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")

# Words that raise a kind's score, and words that lower any (numbers of other things)
_CONTEXT = {
    "email": r"e-?mail|mail|contact|write", "ip": r"ip|address|host|server", "card": r"card|visa|credit|debit|payment",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|account|konto|compte|cuenta|bank",
    "ssn": r"ssn|social security|security number", "tel": r"phone|tel|call|mobile|fax|téléphone|telefon|teléfono",
    "access": r"key|access|aws|id", "secret": r"password|passwd|secret|token|api_?key|key|credential",
}
_NEAR = {kind: re.compile(rf"\b(?:{words})\b", re.IGNORECASE) for kind, words in _CONTEXT.items()}
_OTHER = re.compile(r"\b(?:order|invoice|version|isbn|page|part|serial|ticket)\b", re.IGNORECASE)
_START = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.8, "iban": 0.4, "ssn": 0.4, "tel": 0.4,
          "access": 0.7, "secret": 0.4}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Checksum of account numbers."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Leftmost matches, without trying each character of a long run as a start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        reach = 64
        while True:  # back over the local part, in growing steps
            low = max(done, at - reach)
            start = low + _LOCAL_END.search(text[low:at]).start() if reach <= 64 else _back(text, low, at)
            if start > low or low == done:
                break
            reach *= 8
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _back(text: str, low: int, at: int) -> int:
    last = low
    for other in _NOT_LOCAL.finditer(text, low, at):
        last = other.end()
    return last


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def ibans(text: str):
    """(start, end) of confirmed account numbers. A match may hold words that follow the number, so the country's length
    fixes the end; the whole match is tried next and, for countries without a known length, each shorter group."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        ends = [m.start() + i + 1 for i, c in enumerate(m[0]) if c != " " and m[0][i + 1:i + 2] in ("", " ")]
        if length := _LENGTHS.get(m[0][:2]):
            ends = [e for e in ends if e - m.start() - text.count(" ", m.start(), e) == length] + [m.end()]
        for end in sorted(ends, reverse=True) if not length else ends:
            number = text[m.start():end].replace(" ", "")
            if (len(number) >= min(_COUNTRIES) or end == m.end()) and mod_97(number):
                yield m.start(), end
                at = end
                break
        else:
            at = m.start() + 1  # another number may begin within the match


def _score(text: str, kind: str, start: int, confirmed: bool) -> float:
    before = text[max(0, start - REACH):start]
    score = _START[kind] + 0.4 * confirmed + 0.3 * bool(_NEAR[kind].search(before)) - 0.2 * bool(_OTHER.search(before))
    return min(1.0, max(0.0, score))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order; no two overlap."""
    starts, ends = [], []
    for s in sorted(spans, key=lambda s: s.start):
        if ends and s.start < ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    return starts, ends


def find(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then kind in the order of KINDS; a null text has none.

    An added span that overlaps an earlier kind's span is left out.
    """
    if not text:
        return []
    spans = [Span(k, a, b, _score(text, k, a, k == "card")) for k, a, b in base_spans(text)]
    added = []
    if _DIGIT.search(text):
        added += [("iban", a, b) for a, b in ibans(text)]
        added += [(kind, *m.span()) for kind, pattern in (("ssn", _SSN), ("tel", _TEL)) for m in pattern.finditer(text)]
        added += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        added += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        added += [("secret", *m.span()) for m in _HEX.finditer(text)]
    starts, ends = _merged(spans)
    for kind, start, end in added:
        score = _score(text, kind, start, kind == "iban")
        at = bisect_left(starts, end)  # of the taken stretches, the last that begins before the end
        if score >= LEAST and not (at and ends[at - 1] > start):
            spans.append(Span(kind, start, end, score))
            starts.insert(at, start)
            ends.insert(at, end)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones together) replaced by the kind of its first."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k].start < end:
            end = max(end, spans[k].end)
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_spans(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add the spans of every whole text (array of kind, start, end, score); null and empty texts have none."""
    fields = f"`{into}` array<struct<kind:string,start:long,end:long,score:double>>"
    return add_columns(df, [text], fields, lambda: lambda texts: ([[s._asdict() for s in find(t)] for t in texts],))


def redact_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace personal data in every whole text; a null text stays null."""
    columns = df.columns
    made = add_columns(df, [text], "`__redacted` string", lambda: lambda texts: ([redact(t, find(t)) for t in texts],))
    return made.select(*[made["__redacted"].alias(c) if c == text else made[f"`{c}`"] for c in columns])
