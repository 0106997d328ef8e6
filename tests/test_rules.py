"""Edge cases of rules, formats, filters and mappings on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Observation, functions as F

from millrace.functions import formats
from millrace.operators.filters import Condition, apply_filter, filter_counts
from millrace.operators.mapping import Mapping, apply_mapping
from millrace.operators.rules import InvalidRules, Rule, apply_rules, check_rules
from tests.conftest import rows


def one(spark, schema, value, rule, target="t"):
    return apply_rules(spark.createDataFrame([(value,)], schema), [rule]).first()[target]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "  Ann ", "a,b,c", 2.5), (2, None, "x", -1.5), (3, "bob", None, 3.5)],
        "id int, name string, tags string, score double")


def test_rules_read_the_input_and_the_last_writer_wins(people):
    out = apply_rules(people, [
        Rule("name", "name", "Uppercase", order=2), Rule("name", "copy", "Copy", order=3),
        Rule("tags", "name", "Copy", order=1)])
    assert rows(out, "id", "name", "copy") == [
        (1, "  ANN ", "  Ann "), (2, "x", None), (3, "BOB", "bob")]


def test_null_source_keeps_the_target(people):
    out = apply_rules(people, [Rule("name", "tags", "Trim")])
    assert rows(out, "id", "tags") == [(1, "Ann"), (2, "x"), (3, "bob")]


def test_missing_source_column_is_skipped(people):
    assert apply_rules(people, [Rule("nope", "out", "Uppercase")]).columns == people.columns


def test_one_projection(people, capsys):
    out = apply_rules(people, [Rule("name", f"n{i}", "Uppercase", order=i) for i in range(20)])
    out.explain()
    assert capsys.readouterr().out.count("Project") == 1


@pytest.mark.parametrize("params,expected", [
    ({"index": "1"}, "b"), ({"index": "9"}, None), ({"index": "-1"}, None), ({"index": "x"}, "a"),
    ({"separator": "", "index": "0"}, "a,b,c"), ({"separator": "", "index": "1"}, None), ({"separator": "."}, "a,b,c")])
def test_split(spark, params, expected):
    out = apply_rules(spark.createDataFrame([("a,b,c",)], "s string"), [Rule("s", "t", "Split", params=params)])
    assert (out.first()["t"] if "t" in out.columns else None) == expected


def test_split_out_of_range_keeps_the_previous_target(people):
    out = apply_rules(people, [Rule("tags", "name", "Split", params={"index": "2"})])
    assert rows(out, "id", "name") == [(1, "c"), (2, None), (3, "bob")]


@pytest.mark.parametrize("params,expected", [
    ({}, "hello"), ({"startIndex": "1", "length": "3"}, "ell"), ({"startIndex": "-4", "length": "2"}, "he"),
    ({"startIndex": "9"}, ""), ({"startIndex": "3", "length": "99"}, "lo"), ({"length": "0"}, ""), ({"length": "-2"}, "hello")])
def test_substring(spark, params, expected):
    assert one(spark, "s string", "hello", Rule("s", "t", "Substring", params=params)) == expected


def test_replace_is_literal_and_empty_old_value_changes_nothing(spark):
    assert one(spark, "s string", "a.b.c", Rule("s", "t", "Replace", params={"oldValue": ".", "newValue": "$1"})) == "a$1b$1c"
    df = spark.createDataFrame([("a", "keep")], "s string, t string")
    assert apply_rules(df, [Rule("s", "t", "Replace", params={"newValue": "x"})]).first()["t"] == "keep"


@pytest.mark.parametrize("kind,value,expected", [
    ("Round", 2.5, 2.0), ("Round", 3.5, 4.0), ("Round", -1.5, -2.0), ("Floor", -1.5, -2.0), ("Ceiling", -1.5, -1.0)])
def test_rounding(spark, kind, value, expected):
    assert one(spark, "v double", value, Rule("v", "t", kind)) == expected


def test_rounding_text_keeps_what_does_not_parse(spark):
    df = spark.createDataFrame([("2.5",), ("n/a",), ("1d",), (None,)], "v string")
    assert [r["t"] for r in apply_rules(df, [Rule("v", "t", "Round")]).collect()] == ["2", "n/a", "1d", None]


def test_concatenate_skips_nulls_and_missing(people):
    out = apply_rules(people, [Rule("id, name ,nope,tags", "t", "Concatenate", params={"separator": "-"})])
    assert rows(out, "id", "t") == [(1, "1-  Ann -a,b,c"), (2, "2-x"), (3, "3-bob")]
    assert apply_rules(people, [Rule("nope", "t", "Concatenate")]).first()["t"] == ""


@pytest.mark.parametrize("condition,expected", [
    ("== 10", "y"), ("== 10.0", "n"), ("!= 3", "y"), ("> 9", "y"), ("< 9", "n"), (">= 10", "n"), ("<= 10", "n"), ("> x", "n"),
    ("contains 1", "y"), ("startsWith 0", "n"), ("endsWith 0", "y"), ("", "n"), ("like 1", "n")])
def test_conditional(spark, condition, expected):
    rule = Rule("v", "t", "Conditional", params={"condition": condition, "trueValue": "y", "falseValue": "n"})
    df = spark.createDataFrame([(10.0,), (None,)], "v double")
    with pytest.warns() if condition in (">= 10", "<= 10", "> x", "like 1") else _quiet():
        assert [r["t"] for r in apply_rules(df, [rule]).collect()] == [expected, "n"]


class _quiet:
    def __enter__(self):
        return self

    def __exit__(self, *exc):
        return False


@pytest.mark.parametrize("spec,value,expected", [
    ("F2", 1234.5, "1234.50"), ("F0", 2.5, "3"), ("N1", -1234567.25, "-1,234,567.3"), ("P1", 0.1234, "12.3 %"),
    ("E2", 12345.0, "1.23E+004"), ("C", 5.0, "¤5.00"), ("0.00", 3.14159, "3.14"), ("#,##0", 1234567.0, "1,234,567"),
    ("000.0", 7.0, "007.0"), ("0.0##", 1.25, "1.25"), ("#.##", 0.5, ".5"), ("0%", 0.256, "26%"), ("G", 10.0, "10")])
def test_number_formats(spark, spec, value, expected):
    assert one(spark, "v double", value, Rule("v", "t", "NumberFormat", spec)) == expected


def test_integer_formats(spark):
    assert one(spark, "v int", -42, Rule("v", "t", "NumberFormat", "D5")) == "-00042"
    assert one(spark, "v int", 255, Rule("v", "t", "NumberFormat", "X4")) == "00FF"
    with pytest.warns():
        assert one(spark, "v double", 1.5, Rule("v", "t", "NumberFormat", "D5")) == "1.5"


@pytest.mark.parametrize("template,value,expected", [
    ("<{0}>", 10.0, "<10>"), ("{{{0:F1}}}", 2.0, "{2.0}"), ("{0,6}|", 12.0, "    12|"), ("{0,-6}|", 12.0, "12    |")])
def test_composite_format(spark, template, value, expected):
    assert one(spark, "v double", value, Rule("v", "t", "Format", template)) == expected


def test_bad_composite_format_passes_the_value_through(spark):
    with pytest.warns():
        assert one(spark, "v string", "x", Rule("v", "t", "Format", "{1}")) == "x"


@pytest.mark.parametrize("spec,expected", [
    ("yyyy-MM-dd", "2024-03-05"), ("dd/MM/yy hh:mm tt", "05/03/24 02:07 PM"), ("dddd d MMMM", "Tuesday 5 March"),
    ("HH'h'mm", "14h07"), ("s", "2024-03-05T14:07:09"), ("yyyy.fff", "2024.250"), ("d", "03/05/2024")])
def test_date_formats(spark, spec, expected):
    moment = dt.datetime(2024, 3, 5, 14, 7, 9, 250000)
    assert one(spark, "v timestamp", moment, Rule("v", "t", "DateFormat", spec)) == expected


def test_date_text(spark):
    df = spark.createDataFrame([("2024-03-05",), ("3/5/2024",), ("soon",)], "v string")
    out = apply_rules(df, [Rule("v", "t", "DateFormat", "yyyyMMdd")])
    assert [r["t"] for r in out.collect()] == ["20240305", "20240305", "soon"]


def test_unknown_date_token():
    with pytest.raises(formats.UnsupportedFormat):
        formats.date_pattern("yyyy QQQ")


def test_rule_checks():
    errors = check_rules([Rule("", "t", "Copy"), Rule("s", None, "Trim"), Rule("s", "t", "Format"), Rule("s", "t", "Custom"),
                          Rule("s", "t", "Nope"), Rule("s", None, "Custom", params={"a": "b"})])
    assert len(errors) == 5


def test_bad_rules_raise(people):
    with pytest.raises(InvalidRules):
        apply_rules(people, [Rule("", "t", "Copy")])


def test_lookup_rule_leaves_unknown_keys_null_and_never_multiplies(spark, people):
    codes = spark.createDataFrame([(1, "one"), (1, "uno"), (3, "three")], "code int, label string")
    rule = Rule("id", "label", "Lookup", params={"table": "codes", "key": "code", "value": "label"})
    assert rows(apply_rules(people, [rule], {"codes": codes}), "id", "label") == [(1, "one"), (2, None), (3, "three")]


# -- filters ----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(
        [(1, "Apple", "10", 10.0), (2, None, "n/a", 2.5), (3, "pineAPPLE", "1,000.5", None), (4, "pear", "1e3", 7.0)],
        "id int, name string, text string, num double")


@pytest.mark.parametrize("condition,expected", [
    (("name", "equals", "Apple"), [1]), (("name", "equals", "apple"), []), (("name", "notEquals", "Apple"), [3, 4]),
    (("name", "contains", "APPLE"), [1, 3]), (("name", "startsWith", "aPP"), [1]), (("name", "endsWith", "le"), [1, 3]),
    (("text", "greaterThan", "9"), [1, 3]), (("text", "lessThan", "11"), [1]), (("num", "greaterThan", "5"), [1, 4]),
    (("num", "equals", "10"), [1]), (("num", "equals", "10.0"), []), (("num", "greaterThan", "many"), []),
    (("id", "equals", "2"), [2]), (("id", "equals", "2.0"), []), (("id", "notEquals", "02"), [1, 2, 3, 4]),
    (("gone", "notEquals", "x"), []), (("name", "like", "Apple"), [])])
def test_filter(values, condition, expected):
    kept = apply_filter(values, [Condition(*condition)])
    assert [r["id"] for r in kept.orderBy("id").collect()] == expected


def test_filter_counts_by_observation(values):
    conditions = [Condition("name", "contains", "apple"), Condition("num", "greaterThan", "1")]
    seen = Observation()
    assert apply_filter(values, conditions, seen).count() == 1
    assert seen.get == {"OriginalCount": 4, "FilteredCount": 1}
    assert filter_counts(values, conditions).first().asDict() == {"OriginalCount": 4, "FilteredCount": 1}


def test_filter_reaches_the_scan(spark, sf, capsys):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    apply_filter(orders, [Condition("o_totalprice", "greaterThan", "100000"),
                          Condition("o_orderstatus", "equals", "F")]).select("o_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan


# -- mappings ---------------------------------------------------------------------------------------------------

def test_mapping(values):
    out = apply_mapping(values, [
        Mapping("id", "key"), Mapping("name", "name", transformation="uppercase"),
        Mapping("text", "whole", transformation="parseInt"), Mapping("text", "real", transformation="parseDouble"),
        Mapping("num", "shown", transformation="other"), Mapping("gone", "gone")])
    assert out.columns == ["key", "name", "whole", "real", "shown"]
    assert rows(out) == [(1, "APPLE", 10, 10.0, "10"), (2, "", None, None, "2.5"), (3, "PINEAPPLE", None, None, ""),
                         (4, "PEAR", None, 1000.0, "7")]


def test_required_mapping(values):
    assert rows(apply_mapping(values, [Mapping("id", "id"), Mapping("name", "n", required=True)]), "id") == [(1,), (3,), (4,)]
    assert apply_mapping(values, [Mapping("id", "id"), Mapping("gone", "n", required=True)]).isEmpty()


def test_parse_int_is_strict(spark):
    df = spark.createDataFrame([("5.0",), (" 7 ",), ("-3",), ("99999999999",)], "s string")
    out = apply_mapping(df, [Mapping("s", "i", transformation="parseInt")])
    assert [r["i"] for r in out.collect()] == [None, 7, -3, None]


def test_decimal_text_keeps_its_scale(spark):
    df = spark.createDataFrame([(Decimal("10.00"),)], "d decimal(10,2)").withColumn("s", F.col("d"))
    assert apply_mapping(df, [Mapping("d", "d", transformation="text")]).first()["d"] == "10.00"


@pytest.mark.parametrize("rule,value,expected", [
    ("Floor", 1e20, 1e20), ("Ceiling", -1e20, -1e20), ("Floor", float("inf"), float("inf")), ("Floor", -1.5, -2.0), ("Ceiling", 1.2, 2.0),
    ("Floor", 2.0**53 + 2, 2.0**53 + 2)])
def test_whole_numbers_beyond_bigint(spark, rule, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert apply_rules(df, [Rule("v", "o", rule)]).first()["o"] == expected


def test_floor_of_nan_is_nan(spark):
    out = apply_rules(spark.createDataFrame([(float("nan"),)], "v double"), [Rule("v", "o", "Floor")]).first()["o"]
    assert out != out


@pytest.mark.parametrize("spec,value,expected", [
    ("F15", 1.123456789012345, "1.123456789012345"), ("N2", 1e30, "1" + ",000" * 10 + ".00"),
    ("N2", float("nan"), "NaN"), ("F2", 1e27, "1" + "0" * 27 + ".00"), ("F2", 2.345, "2.35"), ("P1", 0.1234, "12.3 %"),
    ("C2", -1234.5, "(¤1,234.50)"), ("#,##0.0", float("nan"), "NaN")])
def test_number_formats_at_the_edge(spark, spec, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert apply_rules(df, [Rule("v", "o", "NumberFormat", format=spec)]).first()["o"] == expected
