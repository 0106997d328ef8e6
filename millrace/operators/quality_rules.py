"""Data-quality rules: each row gets a list of (rule, severity, valid, message)."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import TEMPORAL, as_text, field, numeric_value
from millrace.operators import skew
from millrace.session import materialize

SEVERITIES = ("Info", "Warning", "Error", "Critical")

# The reason shown for each failed rule type.
REASONS = {
    "NotNull": "Field '{target}' must not be null",
    "Regex": "Field '{target}' does not match the required pattern",
    "Range": "Field '{target}' is outside the allowed range",
    "Unique": "Field '{target}' must be unique",
    "Comparison": "Field '{target}' fails comparison with '{related}'",
    "Custom": "Field '{target}' fails custom validation",
}


@dataclass(frozen=True)
class QualityRule:
    name: str
    type: str
    target: str
    params: dict = dc_field(default_factory=dict)
    related: str | None = None
    severity: str = "Error"

    @classmethod
    def from_dict(cls, spec: dict) -> "QualityRule":
        return cls(spec["name"], spec["type"], spec["target"], dict(spec.get("params") or {}), spec.get("related"),
                   spec.get("severity", "Error"))


def _range(df: DataFrame, rule: QualityRule) -> Column:
    dtype = df.schema[rule.target].dataType
    low, high = rule.params.get("min"), rule.params.get("max")
    if isinstance(dtype, TEMPORAL):
        value = field(rule.target)
        bound = lambda b: F.lit(str(b)).cast(dtype)
    else:
        value = numeric_value(df, rule.target)
        bound = F.lit
    test = value.isNotNull()
    if low is not None:
        test = test & (value >= bound(low))
    if high is not None:
        test = test & (value <= bound(high))
    return test


def _comparison(df: DataFrame, rule: QualityRule) -> Column:
    """A null related value sorts below every value, so ne, gt and ge hold and eq, lt and le do not."""
    if not rule.related or rule.related not in df.columns:
        return F.lit(False)
    left, right = field(rule.target), field(rule.related)
    l_type, r_type = df.schema[rule.target].dataType, df.schema[rule.related].dataType
    operator = rule.params.get("operator", "eq")
    if l_type != r_type:
        if operator in ("eq", "ne"):  # values of different types are never equal
            return left.isNotNull() & F.lit(operator == "ne")
        left, right = as_text(left, l_type), as_text(right, r_type)
    tests = {
        "eq": (left == right, False), "ne": (left != right, True), "gt": (left > right, True),
        "ge": (left >= right, True), "lt": (left < right, False), "le": (left <= right, False),
    }
    if operator not in tests:
        return F.lit(False)
    test, when_related_null = tests[operator]
    return F.when(left.isNull(), False).when(right.isNull(), when_related_null).otherwise(test)


def is_valid(df: DataFrame, rule: QualityRule) -> Column:
    """Boolean column, never null. Unique reads the marker that :func:`with_unique_marks` adds."""
    if rule.target not in df.columns:
        return F.lit(False)
    value = field(rule.target)
    if rule.type == "NotNull":
        return value.isNotNull()
    if rule.type == "Regex":
        pattern = rule.params.get("pattern")
        if pattern is None:
            return F.lit(False)
        return F.coalesce(as_text(value, df.schema[rule.target].dataType).rlike(pattern), F.lit(False))
    if rule.type == "Range":
        return _range(df, rule)
    if rule.type == "Unique":
        return field(_mark(rule.target)).isNull() if _mark(rule.target) in df.columns else F.lit(True)
    if rule.type == "Comparison":
        return _comparison(df, rule)
    if rule.type == "Custom":
        expression = rule.params.get("expression")
        return F.coalesce(F.expr(expression), F.lit(False)) if expression else F.lit(True)
    return F.lit(False)


def _mark(name: str) -> str:
    return f"__dup_{name}"


def _digest(df: DataFrame, name: str) -> list[Column]:
    """A 128-bit hash of a value in two numbers, equal wherever grouping treats values as equal."""
    value, dtype = field(name), df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)
    elif "map<" in dtype.simpleString():
        value = F.to_json(value)
    return [F.xxhash64(F.lit(seed), value.isNull(), value) for seed in (0, 1)]


def with_unique_marks(df: DataFrame, columns: list[str], max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add a non-null marker to rows whose value occurs more than once (nulls count as a value).

    One pass counts the values of all columns together, by their 128-bit hashes and with partial counts before the
    shuffle; the repeated ones are written and joined back. The counts also tell which values fill many rows.
    """
    if not columns:
        return df
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *[c.alias(n) for c, n in zip(_digest(df, name), "ab")])
                      for i, name in enumerate(columns)])
    repeated = materialize(df.select(F.inline(cells)).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = {r["i"]: r["count"] for r in repeated.filter(F.col("n") > max_group_rows).groupBy("i").count().collect()}
    marked = df.select("*", *[c.alias(f"__dup_{n}_{i}") for i, name in enumerate(columns)
                              for c, n in zip(_digest(df, name), "ab")])
    for i, name in enumerate(columns):
        own, keys = repeated.filter(F.col("i") == i), [f"__dup_a_{i}", f"__dup_b_{i}"]
        heavy = skew.Heavy(own.filter(F.col("n") > max_group_rows).select(F.xxhash64("a", "b").alias("h"), "n"), large.get(i, 0))
        marked = skew.join_per_key(marked, own.select("a", "b", F.lit(True).alias(_mark(name))), keys, "left", ["a", "b"],
                                   null_safe=False, heavy=heavy).drop(*keys)
    return marked


def prepare(df: DataFrame, rules: list[QualityRule], max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    unique = sorted({r.target for r in rules if r.type == "Unique" and r.target in df.columns})
    return with_unique_marks(df, unique, max_group_rows)


def _result(df: DataFrame, rule: QualityRule) -> Column:
    valid = is_valid(df, rule)
    if rule.target not in df.columns:
        message: Column = F.lit(f"Field '{rule.target}' not found in data")
    else:
        reason = REASONS.get(rule.type, "Unknown validation type for field '{target}'") \
            .format(target=rule.target, related=rule.related)
        message = F.when(valid, f"Validation passed for rule '{rule.name}'") \
            .otherwise(f"Validation failed for rule '{rule.name}': {reason}")
    return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"),
                    valid.alias("valid"), message.alias("message"))


def rule_results(df: DataFrame, rules: list[QualityRule]) -> Column:
    """``array<struct<rule,severity,valid,message>>``; call :func:`prepare` first when a Unique rule is present."""
    if not rules:
        return F.array().cast("array<struct<rule:string,severity:string,valid:boolean,message:string>>")
    return F.array(*[_result(df, r) for r in rules])


def validate(df: DataFrame, rules: list[QualityRule], target: str = "results",
             max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Rows with the result of every rule."""
    columns = df.columns
    ready = prepare(df, rules, max_group_rows)
    return ready.select(*[field(c) for c in columns], rule_results(ready, rules).alias(target))


def summary(df: DataFrame, rules: list[QualityRule]) -> DataFrame:
    """Pass and fail counts per rule from one aggregation without exploding the rows."""
    ready = prepare(df, rules)
    counted = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                 F.count_if(is_valid(ready, r)).alias("passed"), F.count_if(~is_valid(ready, r)).alias("failed"))
        for r in rules
    ])
    return ready.agg(counted.alias("rules")).select(F.inline("rules"))


def failed_severity(results: Column) -> Column:
    """Highest severity among the failed rules of a row, null when all passed."""
    ranked = F.transform(F.filter(results, lambda r: ~r["valid"]),
                         lambda r: F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), r["severity"]))
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (F.array_max(ranked) - 1).cast("int"))


def quarantine(df: DataFrame, rules: list[QualityRule], at_least: str = "Error") -> DataFrame:
    """Rows with their worst failed ``severity``, the ``failures`` and ``quarantined``: true from ``at_least`` on."""
    columns = df.columns
    checked = validate(df, rules, "__results").withColumn("severity", failed_severity(F.col("__results")))
    held = F.coalesce(F.col("severity").isin(list(SEVERITIES[SEVERITIES.index(at_least):])), F.lit(False))
    return checked.select(*[field(c) for c in columns], "severity",
                          F.filter("__results", lambda r: ~r["valid"]).alias("failures"), held.alias("quarantined"))


def write_quarantine(df: DataFrame, rules: list[QualityRule], path: str, at_least: str = "Error") -> None:
    """Write both parts in one pass: ``<path>/quarantined=false`` and ``<path>/quarantined=true``."""
    quarantine(df, rules, at_least).write.partitionBy("quarantined").parquet(path)
