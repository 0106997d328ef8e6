"""Small helpers on columns and types shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters treated as white space when trimming.
WHITE_SPACE = "".join(
    chr(c)
    for c in [
        0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FRACTIONAL
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def field(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def as_text(value: Column, dtype: T.DataType, booleans: tuple[str, str] = ("True", "False")) -> Column:
    """Text of a value as the rule language sees it.

    Whole floating numbers print without a fraction (``10``, not ``10.0``); other types use Spark's cast.
    """
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(value, booleans[0]).when(~value, booleans[1])
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def type_of(df: DataFrame, expression: str | Column) -> T.DataType:
    """Type of an expression against a DataFrame (analysis only, no job)."""
    column = F.expr(expression) if isinstance(expression, str) else expression
    return df.select(column.alias("x")).schema[0].dataType


def called(function: Callable, inputs: list[Column], returns: str | T.DataType) -> Column:
    """Values of a Python function of pandas series (one for each input, nulls included), on Arrow batches."""

    def call(*columns: pd.Series) -> pd.Series:
        return pd.Series(function(*columns))

    return F.pandas_udf(call, returns)(*inputs)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def parse_double(text: Column) -> Column:
    """Double from text, null when it is not a plain number (no ``1d``/``1f`` suffixes)."""
    return F.when(text.rlike(r"([0-9.]|NaN|Infinity)\s*$"), trimmed(text).try_cast("double"))


def parse_decimal(text: Column) -> Column:
    """Decimal from text: sign, digits, thousands separators and one point; no exponent."""
    plain = text.rlike(r"^\s*[+-]?(\d[\d,]*(\.\d*)?|\.\d+)\s*$")
    return F.when(plain, F.replace(trimmed(text), F.lit(","), F.lit("")).try_cast("decimal(38,10)"))


def parse_int(text: Column) -> Column:
    """32-bit integer from text; ``5.0`` is not an integer."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), trimmed(text).try_cast("int"))


def numeric_value(df: DataFrame, name: str) -> Column:
    """A column as a number: itself when numeric, else parsed text, null when it does not parse."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NUMERIC):
        return field(name)
    return parse_decimal(as_text(field(name), dtype, ("true", "false")))


def unnest(df: DataFrame, keys: list[str], rows: Column, present: str) -> DataFrame:
    """Key columns and the fields of every struct in an array; ``present`` is a field that is never null.

    The outer form with a filter on top computes the array once. For the plain form Spark adds a size filter below
    it and so computes a costly array twice.
    """
    return df.select(*[field(k) for k in keys], F.inline_outer(rows)).filter(field(present).isNotNull())
