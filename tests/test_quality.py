"""Schema checks, inference, quality rules, contracts and profiles on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import consistency, contracts, inference, profiling, quality_rules, schema_checks
from millrace.operators.quality_rules import QualityRule
from millrace.operators.schema_checks import DataSchema, SchemaField
from tests.conftest import rows


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "abc", 5.0, [1, 2], True), (2, None, -1.0, [], None), (3, "toolongname", None, None, False)],
        "id int, name string, amount double, parts array<int>, ok boolean")


def errors(df, *fields, allow=True):
    return rows(schema_checks.error_list(df, DataSchema("s", list(fields), allow), ["id"]))


def test_required_and_absent(items):
    found = errors(items, SchemaField("name", "String", True), SchemaField("gone", "String", True))
    assert [(r[0], r[1]) for r in found] == [(1, "gone"), (2, "gone"), (2, "name"), (3, "gone")]


def test_null_skips_type_and_constraints(items):
    assert errors(items, SchemaField("name", "Integer")) == [
        (1, "name", "Field 'name' has invalid type. Expected Integer, got String"),
        (3, "name", "Field 'name' has invalid type. Expected Integer, got String")]


def test_constraints(items):
    assert [(r[0], r[1]) for r in errors(items, SchemaField("name", "String", constraints={
        "minLength": 4, "maxLength": 5, "pattern": "^a", "enum": ["abc", "x"]}))] == [
        (1, "name"), (3, "name"), (3, "name"), (3, "name")]
    assert [r[0] for r in errors(items, SchemaField("amount", "Decimal", constraints={"minimum": 0, "maximum": 4}))] == [1, 2]
    assert [r[0] for r in errors(items, SchemaField("parts", "Array", constraints={"minItems": 1, "maxItems": 1}))] == [1, 2]
    assert errors(items, SchemaField("id", "Integer", constraints={"minimum": 1, "maximum": 3})) == []


def test_unknown_fields(items):
    found = errors(items.select("id", "ok"), SchemaField("id", "Integer"), allow=False)
    assert [(r[0], r[1]) for r in found] == [(1, "ok"), (2, "ok"), (3, "ok")]
    assert errors(items.select("id", "ok"), SchemaField("id", "Integer")) == []


def test_variant_types(spark):
    df = spark.createDataFrame([(1, "5"), (2, '"x"'), (3, "[1,2]"), (4, "2.5"), (5, "null"), (6, '{"a":1}'), (7, None)],
                               "id int, j string").select("id", F.try_parse_json("j").alias("v"))

    def wrong(kind):
        return [r[0] for r in errors(df, SchemaField("v", kind))]

    assert wrong("Integer") == [2, 3, 4, 6]
    assert wrong("Array") == [1, 2, 4, 6]
    assert wrong("Object") == [1, 2, 3, 4]
    assert [r[0] for r in errors(df.filter("id = 1"), SchemaField("v", "Integer", constraints={"maximum": 4}))] == [1]


def test_inference(items):
    found = {r["field"]: r for r in inference.infer_fields(items).collect()}
    assert (found["id"]["type"], found["id"]["required"], found["id"]["minimum"], found["id"]["maximum"]) == ("Integer", True, 1.0, 3.0)
    assert (found["name"]["min_length"], found["name"]["max_length"], found["name"]["required"]) == (3, 11, False)
    assert found["name"]["enum_values"] is None
    assert (found["parts"]["type"], found["parts"]["min_items"], found["parts"]["max_items"]) == ("Array", 0, 2)
    assert found["ok"]["type"] == "Boolean"


@pytest.mark.parametrize("distinct,total,is_enum", [(2, 6, True), (3, 6, False), (3, 7, False), (3, 8, True), (10, 100, True),
                                                   (11, 1000, False), (500, 5000, False)])
def test_enum_inference_threshold(spark, distinct, total, is_enum):
    df = spark.range(total).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("s"))
    found = inference.infer_fields(df).first()["enum_values"]
    assert (found is not None) == is_enum
    if is_enum:
        assert found == sorted(f"v{i}" for i in range(distinct))


def test_inferred_schema_accepts_its_own_data(items):
    schema = inference.to_schema("items", inference.infer_fields(items))
    assert schema_checks.error_list(items, schema, ["id"]).isEmpty()


def test_variant_inference_takes_the_majority(spark):
    df = spark.createDataFrame([("1",), ("2",), ('"x"',), ("null",)], "j string").select(F.try_parse_json("j").alias("v"))
    found = inference.infer_fields(df).first()
    assert (found["type"], found["required"], found["minimum"], found["maximum"]) == ("Integer", False, 1.0, 2.0)


def valid(df, *rule):
    out = quality_rules.validate(df, [QualityRule("r", *rule)])
    return [r["v"] for r in out.orderBy("id").select(F.col("results")[0]["valid"].alias("v")).collect()]


def test_rules(items):
    assert valid(items, "NotNull", "name") == [True, False, True]
    assert valid(items, "Regex", "name", {"pattern": "o{2}"}) == [False, False, True]
    assert valid(items, "Regex", "name") == [False, False, False]
    assert valid(items, "Range", "amount", {"min": -1, "max": 4}) == [False, True, False]
    assert valid(items, "Custom", "name") == [True, True, True]
    assert valid(items, "Custom", "name", {"expression": "id < 3"}) == [True, True, False]
    assert valid(items, "NotNull", "gone") == [False, False, False]
    assert valid(items, "Nope", "id") == [False, False, False]


def test_range_on_dates(spark):
    df = spark.sql("SELECT 1 AS id, DATE'2024-01-05' AS d UNION ALL SELECT 2, DATE'2023-12-31'")
    assert valid(df, "Range", "d", {"min": "2024-01-01"}) == [True, False]


@pytest.mark.parametrize("operator,expected", [
    ("eq", [True, False, False, False, False]), ("ne", [False, True, True, True, False]),
    ("gt", [False, False, True, True, False]), ("ge", [True, False, True, True, False]),
    ("lt", [False, True, False, False, False]), ("le", [True, True, False, False, False]), ("zz", [False] * 5)])
def test_comparison(spark, operator, expected):
    df = spark.createDataFrame([(1, 5, 5), (2, 4, 5), (3, 6, 5), (4, 6, None), (5, None, 5)], "id int, a int, b int")
    assert valid(df, "Comparison", "a", {"operator": operator}, "b") == expected


def test_comparison_of_different_types_is_by_text(spark):
    df = spark.createDataFrame([(1, 10, "9")], "id int, a int, b string")
    assert valid(df, "Comparison", "a", {"operator": "lt"}, "b") == [True]
    assert valid(df, "Comparison", "a", {"operator": "ne"}, "b") == [True]


def test_unique_counts_nulls_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, v string")
    assert valid(df, "Unique", "v") == [False, False, True, True]


def test_quarantine_and_contract(items):
    checks = [QualityRule("n", "NotNull", "name", severity="Warning"), QualityRule("a", "Range", "amount", {"min": 0})]
    flagged = quality_rules.quarantine(items, checks)
    assert rows(flagged.filter("NOT quarantined"), "id") == [(1,)]
    assert rows(flagged.filter("quarantined"), "id", "severity") == [(2, "Error"), (3, "Error")]
    contract = contracts.Contract("c", DataSchema("s", [SchemaField("id", "Integer")], True), checks[:1])
    out = contracts.check(items, contract).select("id", "compliance.is_compliant", F.size("compliance.rule_violations").alias("n"))
    assert rows(out) == [(1, True, 0), (2, True, 1), (3, True, 0)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "a"), (None, None)], "n int, s string")
    found = {r["column"]: r for r in profiling.profile(df).collect()}
    n, s = found["n"], found["s"]
    assert (n["row_count"], n["null_count"], n["unique_count"], n["min"], n["max"], n["median"]) == (5, 1, 4, "1", "4", "2.5")
    assert n["statistics"]["p25"] == 1.75 and n["statistics"]["p75"] == 3.25
    assert (s["null_count"], s["empty_count"], s["unique_count"], s["top_values"]) == (2, 1, 2, {"a": 2, " ": 1})
    assert s["median"] is None
    rough = {r["column"]: r for r in profiling.profile(df, approx=True).collect()}
    assert rough["s"]["unique_count"] == 2 and rough["s"]["top_values"] == {"a": 2, " ": 1}


def test_profile_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x int")
    found = profiling.profile(df).first()
    assert (found["unique_count"], found["null_count"], found["median"]) == (0, 1, None)
    assert profiling.unique_counts(df).first()["unique_count"] == 0


def test_anomalies(spark):
    base = spark.range(100).select((F.col("id") % 10).cast("double").alias("v"), F.lit("x").alias("s"))
    later = spark.createDataFrame([(1, 5.0, "x"), (2, None, "x"), (3, 99.0, "y")], "id int, v double, s string")
    out = profiling.anomalies(later, profiling.profile(base), ["v", "s"]).select("id", F.inline("anomalies"))
    assert rows(out) == [(2, "v", "UnexpectedNull"), (3, "s", "OutOfRange"), (3, "s", "UnknownValue"),
                         (3, "v", "OutOfRange"), (3, "v", "Outlier"), (3, "v", "UnknownValue")]


def test_map_columns_can_be_profiled_and_compared(spark):
    df = spark.createDataFrame([(1, {"b": 1, "a": 2}), (2, None)], "id int, m map<string,int>")
    other = spark.createDataFrame([(1, {"a": 2, "b": 1}), (2, {"c": 3})], "id int, m map<string,int>")
    assert rows(profiling.min_max(df, ["m"]), "min", "avg") == [(None, None)]
    assert rows(profiling.profile(df).filter("column = 'm'"), "unique_count", "null_count") == [(1, 1)]
    assert rows(profiling.unique_counts(df, ["m", "id"])) == [("id", 2), ("m", 1)]
    assert rows(consistency.metrics(df, other, ["id"])) == [(0, 1, 2)]


def test_upsert_keeps_the_destination_types(spark):
    source = spark.createDataFrame([(1, 5), (3, 7)], "id bigint, v bigint")
    target = spark.createDataFrame([(1, 2), (2, 3)], "id int, v int")
    merged = consistency.upsert(source, target, ["id"])
    assert merged.schema == target.schema and rows(merged) == [(1, 5), (2, 3), (3, 7)]


def test_profile_reads_the_table_twice(spark, tmp_path, monkeypatch):
    """Once for the value counts, which are written, and once for everything else; nothing is left to the result."""
    spark.range(50).selectExpr("id AS a", "id % 7 AS b", "CAST(id AS STRING) AS c").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = profiling.profile(df)
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows(found, "column", "unique_count", "median") == [("a", 50, "24.5"), ("b", 7, "3.0"), ("c", 50, None)]
