"""Arrays read in splits against Python's own parser."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers
from tests.conftest import rows

SCHEMA = "id bigint, name string, tags array<string>, inner struct<x: bigint, y: string>"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def scan(spark, path, size="100", **spec):
    """The array read in splits of a few bytes, so that strings, escapes and objects lie across their ends."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, size)
    try:
        return readers.json(spark, str(path), schema(spark), split=True, **spec)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def plain(items):
    """Sorted texts of the objects among the items."""
    def row(o):
        inner = o.get("inner")
        return (o.get("id"), o.get("name"), o.get("tags"), (inner.get("x"), inner.get("y")) if inner is not None else None)
    return sorted(map(repr, (row(o) for o in items if isinstance(o, dict))))


def read(spark, path, **spec):
    got = scan(spark, path, **spec)
    return sorted(repr((r["id"], r["name"], r["tags"], tuple(r["inner"]) if r["inner"] is not None else None)) for r in got.collect())


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", " ", "\n", "é", "字", "a", "\\\"", "}}{{", '\\"}'])
                   for _ in range(rng.randrange(0, 90)))


def items_of(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0:
            out.append(rng.choice([None, 5, -1.5, True, odd_text(rng), [], [1, {"id": 7}], [[{"id": 8}], {}], [{"id": 9, "name": "}]"}]]))
            continue
        item = {"id": i}
        if kind > 1:
            item["name"] = odd_text(rng)
        if kind > 3:
            item["tags"] = [odd_text(rng) for _ in range(rng.randrange(3))]
        if kind > 5:
            item["inner"] = {"x": rng.randrange(9), "y": odd_text(rng)}
        out.append(item)
    return out


@pytest.mark.parametrize("seed,indent,ascii_only", [(1, None, True), (2, 2, False), (3, None, False), (4, 1, True)])
def test_any_array(spark, tmp_path, seed, indent, ascii_only):
    items = items_of(seed, 60)
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    assert read(spark, tmp_path) == plain(items)


def test_documents_of_every_form(spark, tmp_path):
    forms = {"empty": "", "blank": " \n", "none": "null", "bare": "[]", "one": '{"id": 1, "inner": {"x": 2}}', "scalars": '[1, "}", null]',
             "array": '[{"id": 2}, {"id": 2}]\n', "tail": '[{"id": 3}, "{", [4]]', "lines": '{"id": 4}\n{"id": 5}\n', "mark": '﻿[{"id": 6}]',
             "wide": '[{"id": 7, "other": [{"deep": [{"er": "}"}]}]}]', "void": "[{}]"}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = scan(spark, tmp_path, keep_corrupt=True)
    assert rows(got.filter("_corrupt_record IS NOT NULL")) == []
    assert sorted(str(r["id"]) for r in got.collect()) == sorted(["1", "2", "2", "3", "4", "5", "6", "7", "None"])


@pytest.mark.parametrize("text,whole,left", [
    ('[{"id": 1}, {"id": 2', [1], '{"id": 2'), ('[{"id": 1}, {"id": 2, "name": "a}', [1], '{"id": 2, "name": "a}'),
    ('[{"id": 1}, {"inner": {"x": 1}', [1], '{"inner": {"x": 1}'), ('[{"id": 1}', [1], None)])
def test_torn_files(spark, tmp_path, text, whole, left):
    (tmp_path / "a.json").write_text(text)
    got = scan(spark, tmp_path, keep_corrupt=True).collect()
    assert [r["id"] for r in got if r["_corrupt_record"] is None] == whole
    assert [r["_corrupt_record"] for r in got if r["_corrupt_record"] is not None] == ([left] if left else [])


def test_values_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": 1}]')
    kept = scan(spark, tmp_path, keep_corrupt=True).select("id", "_corrupt_record")
    assert rows(kept) == [(None, '{"id": "x"}'), (1, None)]
    assert rows(scan(spark, tmp_path).select("id")) == [(1,)]


def test_a_schema_is_needed(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        readers.json(spark, str(tmp_path), split=True)


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "a.json", "w") as out:
        out.write("[")
        for i in range(60_000):
            out.write((", " if i else "") + json.dumps({"id": i, "name": "}{" + "a" * 250}))
        out.write("]")
    got = scan(spark, tmp_path, size="1m")
    assert got.agg(F.count("id"), F.sum("id"), F.min(F.length("name"))).first()[:] == (60_000, 60_000 * 59_999 // 2, 252)
    # the pieces are laid out by split, and a split's pieces are all that one task needs
    written = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/json-array-*"), key=os.path.getmtime)
    assert spark.read.parquet(written).select("block").distinct().count() >= 10
