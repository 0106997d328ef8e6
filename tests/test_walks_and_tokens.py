"""Unlimited lineage walks in few rounds; tokens that are a permutation."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lineage, masking
from millrace.operators.masking import Mask
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame([(f"t{a}", f"t{b}") for a, b in pairs], "source_table string, target_table string")


def tables(spark, *numbers):
    return spark.createDataFrame([(f"t{n}",) for n in numbers], "`table` string")


def plain_walk(pairs, root):
    depth, level, frontier = {root: 0}, 0, {root}
    while frontier:
        level += 1
        frontier = {b for a, b in pairs if a in frontier} - set(depth)
        depth.update(dict.fromkeys(frontier, level))
    return {f"t{n}": d for n, d in depth.items() if d}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(300)], [(i, (i + 1) % 200) for i in range(200)]], ids=["chain", "cycle"])
def test_long_walks_take_few_rounds(spark, monkeypatch, pairs):
    rounds = []
    plain = lineage._round
    monkeypatch.setattr(lineage, "_round", lambda reach, *rest: rounds.append("root_table" in reach.columns) or plain(reach, *rest))
    found = {r["table"]: r.depth for r in lineage.downstream(edges(spark, pairs), tables(spark, 0), None).collect()}
    assert found == plain_walk(pairs, 0)
    assert sum(rounds) <= 10  # log2(300) rounds, and one that finds nothing


@pytest.mark.parametrize("limit", [10**6, 3])
def test_walks_of_made_graphs(spark, limit):
    draw = random.Random(limit)
    pairs = [(draw.randrange(25), draw.randrange(25)) for _ in range(40)] + [(0, i) for i in range(9)] + [(3, 3)]
    roots = [0, 7, 11, 99]
    found = lineage.downstream(edges(spark, pairs), tables(spark, *roots), None, max_group_rows=limit)
    expected = sorted((f"t{r}", n, d) for r in roots for n, d in plain_walk(pairs, r).items())
    assert rows(found, "root_table", "table", "depth") == sorted(expected, key=lambda t: tuple((True, str(v)) for v in t))
    back = lineage.upstream(edges(spark, pairs), tables(spark, 7), None, max_group_rows=limit)
    assert {r["table"]: r.depth for r in back.collect()} == plain_walk([(b, a) for a, b in pairs], 7)


def tokens(spark, values, salt="s"):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.v for r in masking.mask_data(frame, {"v": Mask("Tokenize", {"salt": salt})}).collect()]


def test_tokens_are_a_permutation(spark):
    three = [f"{i:03}" for i in range(1000)]
    assert sorted(tokens(spark, three)) == three and tokens(spark, three) != three
    assert sorted(tokens(spark, list("0123456789"))) == list("0123456789")
    six = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("v"))
    assert masking.mask_data(six, {"v": Mask("Tokenize", {"salt": "s"})}).distinct().count() == 100_000


def test_tokens_keep_classes_and_places(spark):
    values = [None, "", "-", "Ada Lövelace, 42 Σ", "ÀÉß ж Я", "漢字 a1", "x" * 500 + "9"]
    masked = tokens(spark, values)
    assert masked[:3] == [None, "", "-"]
    for value, token in zip(values[3:], masked[3:]):
        assert len(value) == len(token) and value != token
        for c, d in zip(value, token):
            assert next((k for k in masking.CLASSES if c in k), c) == next((k for k in masking.CLASSES if d in k), d)
    assert masked[3:] != tokens(spark, values, "other")[3:]


def plain_token(text, salt):
    """The rounds character by character."""
    chars = list(text)
    for number in range(masking.ROUNDS):
        others = "".join(c for i, c in enumerate(chars) if i % 2 != number % 2)
        by = hashlib.sha256(f"{salt}|{number}|{others}".encode()).digest()
        for i, c in enumerate(chars):
            letters = next((k for k in masking.CLASSES if c in k), None)
            if i % 2 == number % 2 and letters:
                chars[i] = letters[(letters.index(c) + by[i % 32]) % len(letters)]
    return "".join(chars)


def test_tokens_equal_the_plain_rounds(spark, monkeypatch):
    draw = random.Random(5)
    letters = "".join(masking.CLASSES) + " -,.\n\0×÷漢😀\U0010ffff"
    values = ["", "a", "😀", "ÿ9"] + ["".join(draw.choices(letters, k=draw.randrange(200))) for _ in range(300)]
    assert tokens(spark, values, "pépper") == [plain_token(v, "pépper") for v in values]
    # the same in pieces, with texts longer than a piece and without any text
    for chunk in (1, 500):
        monkeypatch.setattr(masking, "CHUNK", chunk)
        assert tokens(spark, [None, *values, None]) == [None, *[plain_token(v, "s") for v in values], None]
    assert masking._turned([None], "s") == [None] and masking._turned([], "s") == []
    assert tokens(spark, [None, None]) == [None, None]


def test_bytes_that_are_no_utf8_keep_their_places(spark):
    value = F.concat(F.lit("ab".encode()), F.unhex(F.lit("FF80")), F.lit("c漢".encode())).cast("string")
    masked = masking.mask_data(spark.range(1).select(value.alias("v")), {"v": Mask("Tokenize", {"salt": "s"})})
    found = bytes(masked.select(F.col("v").cast("binary")).first()[0])
    assert len(found) == 8 and found[2:4] == b"\xff\x80" and found[5:] == "漢".encode()


def test_tokens_of_long_texts_take_few_passes(spark):
    """Characters are not looked at one by one by interpreted functions."""
    frame = spark.range(1).select(F.expr("repeat('Lorem ipsum 2024, ', 220000)").alias("v"))
    masked = masking.mask_data(frame, {"v": Mask("Tokenize", {"salt": "s"})})
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1
    assert masked.select(F.length("v")).first()[0] == 18 * 220000


def test_keyed_masks_need_a_secret(spark):
    frame = spark.createDataFrame([("a",)], "v string")
    for kind in masking.KEYED:
        with pytest.raises(ValueError, match="secret"):
            masking.mask_data(frame, {"v": Mask(kind)})
