"""Record filters: ANDed conditions of (field, operator, value) with text values.

A null or missing field excludes the row, also under ``notEquals``. Values compare as text, except the two
ordering operators, which need numbers on both sides. On typed columns the comparison is rewritten to the
column's own type where that gives the same answer, so it reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from millrace.functions.columns import INTEGRAL, NUMERIC, all_of, as_text, field, numeric_value

OPERATORS = ("equals", "notEquals", "contains", "startsWith", "endsWith", "greaterThan", "lessThan")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str

    @classmethod
    def from_dict(cls, spec: dict) -> "Condition":
        return cls(spec["field"], spec.get("operator", "equals"), str(spec.get("value", "")))


def _decimal(text: str) -> Decimal | None:
    plain = text.strip().replace(",", "")
    if "e" in plain.lower():
        return None
    try:
        value = Decimal(plain)
    except InvalidOperation:
        return None
    return value if value.is_finite() else None


def _numeric_bound(dtype: T.DataType, bound: Decimal) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.lit(float(bound))
    if isinstance(dtype, INTEGRAL) and bound == bound.to_integral_value() and abs(bound) < 2**62:
        return F.lit(int(bound))
    return F.lit(bound)


def _equals(df: DataFrame, name: str, value: str) -> Column:
    dtype = df.schema[name].dataType
    column = field(name)
    if isinstance(dtype, T.StringType):
        return column == value
    if isinstance(dtype, INTEGRAL):  # the text of a whole number is unique, so compare natively
        canonical = value.lstrip("-").isdigit() and str(int(value)) == value and abs(int(value)) < 2**63
        return column == int(value) if canonical else F.when(column.isNotNull(), F.lit(False))
    return as_text(column, dtype, ("true", "false")) == value


def predicate(df: DataFrame, condition: Condition) -> Column:
    """Boolean column for one condition; null counts as excluded by ``filter``."""
    if condition.field not in df.columns:
        return F.lit(False)
    name, operator, value = condition.field, condition.operator, condition.value
    dtype = df.schema[name].dataType
    column = field(name)
    if operator == "equals":
        return _equals(df, name, value)
    if operator == "notEquals":
        return column.isNotNull() & ~_equals(df, name, value)
    if operator in ("contains", "startsWith", "endsWith"):
        text, wanted = F.lower(as_text(column, dtype, ("true", "false"))), value.lower()
        return {"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[operator](wanted)
    if operator in ("greaterThan", "lessThan"):
        bound = _decimal(value)
        if bound is None:
            return F.lit(False)
        number = numeric_value(df, name)
        literal = _numeric_bound(dtype, bound) if isinstance(dtype, NUMERIC) else F.lit(bound)
        return number > literal if operator == "greaterThan" else number < literal
    return F.lit(False)


def apply_filter(df: DataFrame, conditions: list[Condition], observation: Observation | None = None) -> DataFrame:
    """Rows meeting every condition; ``observation`` collects OriginalCount and FilteredCount on the way."""
    conditions = [c if isinstance(c, Condition) else Condition.from_dict(c) for c in conditions]
    kept = all_of([F.coalesce(predicate(df, c), F.lit(False)) if observation else predicate(df, c)
                   for c in conditions])
    if observation is not None:
        # counted above the scan, so the counts see every input row
        df = df.observe(observation, F.count(F.lit(1)).alias("OriginalCount"),
                        F.count_if(kept).alias("FilteredCount"))
    return df.filter(kept)


def filter_counts(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """One row: OriginalCount and FilteredCount."""
    conditions = [c if isinstance(c, Condition) else Condition.from_dict(c) for c in conditions]
    kept = all_of([predicate(df, c) for c in conditions])
    return df.agg(F.count(F.lit(1)).alias("OriginalCount"), F.count_if(kept).alias("FilteredCount"))
