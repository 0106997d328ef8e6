"""Secrets against a plain version: the contract's patterns, and every window counted anew."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from millrace.llm import secrets
from millrace.llm.queries import QUERIES

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = {"assign": (ASSIGN, lambda m: len(m[1]) >= 6), "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)}


def plain_peak(value, window):
    return max(log2(window) - sum(n * log2(n) for n in Counter(value[i:i + window]).values()) / window
               for i in range(len(value) - window + 1))


def plain_spans(text):
    text = text or ""
    base = [(k, m.start(), m.end()) for k, (p, good) in PATTERNS.items() for m in p.finditer(text) if good(m)]
    rest = text
    for pattern, good in PATTERNS.values():
        rest = pattern.sub(lambda m: " " * len(m[0]) if good(m) else m[0], rest)
    added = []
    for c in secrets.CLASSES:
        def reported(m, c=c):
            return len(m[0]) >= c.window and not any(re.fullmatch(p, m[0]) for p in secrets.ALLOWED) and \
                plain_peak(m[0], c.window) >= c.bits - 1e-9
        pattern = re.compile(f"[{c.characters}]+")
        added += [(c.kind, m.start(), m.end()) for m in pattern.finditer(rest) if reported(m)]
        rest = pattern.sub(lambda m: " " * len(m[0]) if reported(m) else m[0], rest)  # noqa: B023
    kinds = [*secrets.BASE, *(c.kind for c in secrets.CLASSES)]
    return sorted(base + added, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(frame).collect()}


def made(seed):
    """Texts of the pieces that matter, run together in any way."""
    draw = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    parts = [lambda: "".join(draw.choices("0123456789abcdef", k=draw.choice([5, 23, 24, 40]))),
             lambda: "".join(draw.choices("0123456789ABCDEFabcdef", k=draw.choice([20, 24, 32]))),
             lambda: "".join(draw.choices(alphabet, k=draw.choice([5, 19, 20, 21, 45]))),
             lambda: "AKIA" + "".join(draw.choices("ABCDEFGHIJ0123456789", k=draw.choice([3, 15, 16, 17]))),
             lambda: draw.choice(["password", "PassWd", "secret", "TOKEN", "api_key", "apikey"]) + draw.choice(["", '"', "'"]) +
             draw.choice(["", " ", "   "]) + draw.choice([":", "=", ""]) + draw.choice(["", "  "]) + draw.choice(["", '"']),
             lambda: draw.choice([" ", "", ",", "\n", "ſecret=", "ü", "😀 ", "Wort", " abc", "x" * 30, "=token=token:abcdef"])]
    return "".join(draw.choice(parts)() for _ in range(draw.randrange(1, 40)))


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")  # the smallest table has no secrets
    rows = QUERIES["op12_secrets"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        base = [s for s in spans if s[0] in PATTERNS]
        some += len(base)
        listed = [",".join(f"{k}:{a}:{b}" for k, a, b in part) for part in (base, spans)]
        assert (r.spans, r.base_sha256) == (listed[1], hashlib.sha256(listed[0].encode()).hexdigest())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in PATTERNS]
    assert some


def test_made_texts_against_plain_spans(spark):
    texts = [made(seed) for seed in range(400)]
    spans = found(spark, texts)
    assert {k for s in spans.values() for k, _, _ in s} == {*secrets.BASE, *(c.kind for c in secrets.CLASSES)}
    for i, text in enumerate(texts):
        assert spans[i] == plain_spans(text), text


def test_defined_cases(spark):
    assert found(spark, [None, "", " ", "token=abc", "token=token:abcdef", "secret=abcdef"]) == \
        {0: [], 1: [], 2: [], 3: [], 4: [], 5: [("assign", 0, 13)]}
    names = ["the_name_of_a_long_function", "Rindfleischetikettierung", "123e4567-e89b-12d3-a456-426614174000",
             "0123456789abcdefghijABCDEFGHIJ", "EXAMPLEkey9Zx0QpL7mW2vB5nT8rY4s"]
    assert all(s == [] for s in found(spark, names).values())
    assert found(spark, ["k9Zx0QpL7mW2vB5nT8rY4s"])[0] == [("entropy_base64", 0, 22)]


def test_long_texts(spark):
    """Many matches, a very long candidate, and a megabyte without any: linear work."""
    many, one = "token=abcdef " * 20_000, "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789", k=60_000))
    spans = found(spark, [many, one, "a b" * 400_000])
    assert spans[0] == [("assign", 13 * i, 13 * i + 12) for i in range(20_000)]
    assert spans[1] == plain_spans(one) and spans[2] == []


@pytest.mark.parametrize("window", [2, 20])
def test_peak_entropy(spark, window):
    values = ["", "a", "ab", "aab", "a" * 30, "".join(map(chr, range(43, 123))), made(3).encode("ascii", "ignore").decode().replace(" ", "")]
    values = ["".join(c for c in v if "+" <= c <= "z") for v in values]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    for r in frame.select("v", secrets.peak_entropy(F.col("v"), window).alias("bits")).collect():
        assert r.bits is None if len(r.v) < window else r.bits == pytest.approx(plain_peak(r.v, window), abs=1e-5)


def test_columns_and_empty_tables(spark):
    """Columns of any name stay; a column of the new name is replaced; repeated and null ids stay as rows."""
    rows = [(None, "secret=abcdef", 1, 2.5, "x"), (7, None, 2, None, "y"), (7, None, 2, None, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, SPANS int, `__secretsr0` double, `a.b` string")
    out = secrets.find_secrets(frame)
    assert out.columns == ["doc_id", "text", "__secretsr0", "a.b", "spans"] and out.count() == 3
    assert {(r["__secretsr0"], r["a.b"], len(r.spans)) for r in out.collect()} == {(2.5, "x", 1), (None, "y", 0)}
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_native_plan(spark, sf):
    plan = QUERIES["op12_secrets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
