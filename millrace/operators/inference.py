"""Schema inference from a whole table in one aggregation.

Each column gives one output row: type, required flag, length, value and item bounds, and an enum list when
the text column has few values. The enum comes from a bounded sketch that is exact while few values exist, so
nothing unbounded is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import field
from millrace.operators.schema_checks import DataSchema, SchemaField, type_name, variant_type_name

ENUM_VALUES = 10
_SKETCH = 64
_VOTES = ("String", "Integer", "Decimal", "Boolean", "DateTime", "Array", "Object")

_ROW = ("struct<field:string,type:string,required:boolean,min_length:int,max_length:int,minimum:double,"
        "maximum:double,min_items:int,max_items:int,enum_values:array<string>>")


def _enum(text: Column) -> Column:
    """Sorted distinct values when there are at most ten and fewer than half the sample count, else null.

    The sketch accounts for every sample only while it tracks every distinct value, so equality of the counts
    proves that the list is complete.
    """
    top = F.call_function("approx_top_k", text, F.lit(ENUM_VALUES + 1), F.lit(_SKETCH))
    seen = F.count(text)
    known = F.filter(top, lambda e: e["item"].isNotNull())
    covered = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, e: a + e["count"])
    few = (F.size(known) <= ENUM_VALUES) & (covered == seen) & (F.size(known) < F.floor(seen / 2))
    return F.when(few, F.array_sort(F.transform(known, lambda e: e["item"])))


def _describe(name: str, kind: str, value: Column, typed: dict[str, Column]) -> Column:
    text, number, items = typed.get("String"), typed.get("number"), typed.get("Array")
    none = F.lit(None)
    return F.struct(
        F.lit(name), F.lit(kind), F.count_if(value.isNull()) == 0,
        F.min(F.length(text)) if text is not None else none, F.max(F.length(text)) if text is not None else none,
        F.min(number) if number is not None else none, F.max(number) if number is not None else none,
        F.min(F.size(items)) if items is not None else none, F.max(F.size(items)) if items is not None else none,
        _enum(text) if text is not None else none,
    ).cast(_ROW)


def _column(name: str, dtype: T.DataType) -> Column:
    value = field(name)
    if isinstance(dtype, T.VariantType):
        return _variant_column(name)
    kind = type_name(dtype)
    typed = {
        "String": {"String": value.cast("string")},
        "Integer": {"number": value.cast("double")},
        "Decimal": {"number": value.cast("double")},
        "Array": {"Array": value},
    }.get(kind, {})
    return _describe(name, kind, value, typed)


def _variant_parts(name: str) -> list[Column]:
    """The value's type and its text, number or items, worked out once per row before the aggregation."""
    value = field(name)
    kind = F.when(value.isNotNull() & (F.schema_of_variant(value) != "VOID"), variant_type_name(value))
    return [kind.alias(f"__kind_{name}"), F.try_variant_get(value, "$", "string").alias(f"__text_{name}"),
            F.try_variant_get(value, "$", "double").alias(f"__number_{name}"),
            F.size(F.try_variant_get(value, "$", "array<variant>")).alias(f"__items_{name}")]


def _variant_column(name: str) -> Column:
    """Type by majority vote; constraints only where the winning type has them."""
    kind = field(f"__kind_{name}")
    votes = F.array(*[F.struct(F.count_if(kind == v).alias("n"), F.lit(-i).alias("rank"), F.lit(v).alias("type"))
                      for i, v in enumerate(_VOTES)])
    winner = F.array_max(votes)["type"]
    text = F.when(kind == "String", field(f"__text_{name}"))
    number = F.when(kind.isin("Integer", "Decimal"), field(f"__number_{name}"))
    items = F.when(kind == "Array", field(f"__items_{name}"))
    is_text, is_number = winner == "String", winner.isin("Integer", "Decimal")
    return F.struct(
        F.lit(name), winner, F.count_if(kind.isNull()) == 0,
        F.when(is_text, F.min(F.length(text))), F.when(is_text, F.max(F.length(text))),
        F.when(is_number, F.min(number)), F.when(is_number, F.max(number)),
        F.when(winner == "Array", F.min(items)), F.when(winner == "Array", F.max(items)),
        F.when(is_text, _enum(text)),
    ).cast(_ROW)


def infer_fields(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column with its inferred type and constraints."""
    types = {f.name: f.dataType for f in df.schema.fields}
    described = F.array(*[_column(c, types[c]) for c in columns or df.columns])
    variants = [c for c in columns or df.columns if isinstance(types[c], T.VariantType)]
    if variants:
        df = df.select("*", *[part for c in variants for part in _variant_parts(c)])
    return df.agg(described.alias("fields")).select(F.inline("fields"))


def infer_from_record(record: DataFrame) -> DataFrame:
    """Inference from a single record: the first row of ``record``."""
    return infer_fields(record.limit(1))


def to_schema(name: str, inferred: DataFrame) -> DataSchema:
    """Schema object from inference output (one small row per column)."""
    names = {"min_length": "minLength", "max_length": "maxLength", "minimum": "minimum", "maximum": "maximum",
             "min_items": "minItems", "max_items": "maxItems", "enum_values": "enum"}
    fields = []
    for row in inferred.collect():
        limits = {target: row[source] for source, target in names.items() if row[source] is not None}
        fields.append(SchemaField(row["field"], row["type"], row["required"], limits))
    return DataSchema(name, fields)
