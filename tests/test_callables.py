"""Python functions in rules, masks, calculated fields and job steps."""

from __future__ import annotations

import pytest

from millrace.operators import enrichment
from millrace.operators.masking import Mask, mask_data
from millrace.operators.rules import Rule, apply_rules
from millrace.plans.job import Job, compile_job
from tests.conftest import rows


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "ab", 2.0), (2, None, 3.0), (3, "", None)], "id int, name string, v double")


def backwards(texts):
    return texts.map(lambda t: t[::-1] if t is not None else "none")


def test_custom_rule(items):
    out = apply_rules(items, [
        Rule("name", "name", "Custom", params={"call": backwards}),
        Rule("id, v", "sum", "Custom", params={"call": lambda i, v: i + v, "returns": "double"}, order=1),
        Rule("sum", "sum2", "Copy", order=2),  # rules do not chain
        Rule("id, nowhere", "lost", "Custom", params={"call": backwards})])
    assert out.columns == ["id", "name", "v", "sum"]
    assert rows(out) == [(1, "ba", 2.0, 3.0), (2, "none", 3.0, 5.0), (3, "", None, None)]
    assert apply_rules(items.limit(0), [Rule("name", "n", "Custom", params={"call": backwards})]).collect() == []


def test_custom_mask(items):
    assert rows(mask_data(items, {"name": Mask("Custom", {"call": backwards})}), "name") == [("",), ("ba",), ("none",)]
    ids = mask_data(items, {"id": Mask("Custom", {"call": lambda i: i * 10, "returns": "int"})})
    assert rows(ids, "id") == [(10,), (20,), (30,)] and ids.schema["id"].dataType.simpleString() == "int"


def test_custom_calculated_field(items):
    out = enrichment.enrich_calculated(items, "w", "Custom", fields=["id", "v"], params={"call": lambda i, v: i * v})
    assert rows(out, "id", "w") == [(1, 2.0), (2, 6.0), (3, None)]


def test_job_steps(spark, items, tmp_path):
    items.write.parquet(str(tmp_path / "in"))
    lookup = spark.createDataFrame([(1, "one"), (2, "two"), (2, "deux")], "number int, word string")
    job = Job.from_dict({"name": "calls", "source": {"path": str(tmp_path / "in")}, "steps": [
        {"type": "rules", "config": {"rules": [{"source": "name", "target": "name", "type": "Custom", "params": {"call": "back"}}]}},
        {"type": "mask", "config": {"masks": {"v": {"type": "Custom", "params": {"call": "twice", "returns": "double"}}}}},
        {"type": "calculate", "config": {"target": "w", "kind": "Custom", "fields": ["v"], "params": {"call": "twice"}}},
        {"type": "lookup", "config": {"table": "words", "source_key": "id", "lookup_key": "number", "value_fields": ["word"],
                                      "include_null_matches": True}},
        {"type": "by_key", "config": {"key": "id", "call": "squares", "schema": "id int, square int"}},
        {"type": "predict", "config": {"call": "model", "input_fields": ["id"], "target": "guess"}},
        {"type": "names", "config": {"text": "name", "names": [["ba", "x"]], "target": "found"}},
        {"type": "function", "config": {"call": "tail", "schema": "id int, name string, w double, word string, square int, guess double, hits int",
                                        "params": {"least": 2}}}]})
    functions = {
        "back": backwards, "twice": lambda v: v * 2, "squares": lambda f: f.assign(square=f["id"] ** 2),
        "model": lambda: lambda batch: batch["id"] + 0.5,
        "tail": lambda f, p: f[f["id"] <= p["least"]].assign(hits=lambda g: g["found"].map(len)).drop(columns=["v", "found"])}
    out = compile_job(spark, job, {"words": lookup}, functions)
    assert rows(out) == [(1, "ba", 8.0, "one", 1, 1.5, 1), (2, "none", 12.0, "deux", 4, 2.5, 0)]
    with pytest.raises(ValueError, match="unknown function 'back'"):
        compile_job(spark, job, {"words": lookup})
