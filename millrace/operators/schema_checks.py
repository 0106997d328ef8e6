"""Schema validation: one row in, a list of (field, message) errors out.

Null values skip type and constraint checks. Typed columns have their type test decided once from the
DataFrame schema; ``VARIANT`` columns (parsed JSON) are tested value by value.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import INTEGRAL, field, unnest

# The wording of schema errors.
MESSAGES = {
    "required": "Required field '{name}' is missing or null",
    "unknown": "Field '{name}' is not defined in the schema",
    "type": "Field '{name}' has invalid type. Expected {expected}, got {actual}",
    "minLength": "Field '{name}' length is less than minimum length of {bound}",
    "maxLength": "Field '{name}' length exceeds maximum length of {bound}",
    "pattern": "Field '{name}' does not match pattern '{bound}'",
    "enum": "Field '{name}' value is not in the allowed values list",
    "minimum": "Field '{name}' value is less than minimum of {bound}",
    "maximum": "Field '{name}' value exceeds maximum of {bound}",
    "minItems": "Field '{name}' has fewer items than minimum of {bound}",
    "maxItems": "Field '{name}' has more items than maximum of {bound}",
}

FIELD_TYPES: dict[str, tuple] = {
    "String": (T.StringType,),
    "Integer": INTEGRAL,
    "Decimal": (T.FloatType, T.DoubleType, T.DecimalType),
    "Boolean": (T.BooleanType,),
    "DateTime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "Array": (T.ArrayType,),
    "Object": (T.StructType, T.MapType),
}
# how schema_of_variant names the same types
_VARIANT_TYPES = {
    "String": r"^STRING$", "Integer": r"^(TINYINT|SMALLINT|INT|BIGINT)$", "Decimal": r"^(FLOAT|DOUBLE|DECIMAL.*)$",
    "Boolean": r"^BOOLEAN$", "DateTime": r"^(DATE|TIMESTAMP.*)$", "Array": r"^ARRAY.*$", "Object": r"^(OBJECT|STRUCT).*$",
}
_CASTS = {"String": "string", "Integer": "bigint", "Decimal": "double"}

ERROR = T.StructType([T.StructField("field", T.StringType()), T.StructField("message", T.StringType())])


@dataclass(frozen=True)
class SchemaField:
    name: str
    type: str
    required: bool = False
    constraints: dict = dc_field(default_factory=dict)


@dataclass(frozen=True)
class DataSchema:
    name: str
    fields: list[SchemaField]
    allow_unknown: bool = False

    @classmethod
    def from_dict(cls, spec: dict) -> "DataSchema":
        return cls(spec.get("name", ""), [SchemaField(**f) for f in spec["fields"]],
                   bool(spec.get("allow_unknown", False)))


def type_name(dtype: T.DataType) -> str:
    """Field type of a Spark type; String where nothing else fits."""
    return next((n for n, kinds in FIELD_TYPES.items() if isinstance(dtype, kinds)), "String")


def variant_type_name(value: Column) -> Column:
    """Field type of each variant value."""
    described = F.schema_of_variant(value)
    chosen = F.lit("String")
    for name, pattern in _VARIANT_TYPES.items():
        if name != "String":
            chosen = F.when(described.rlike(pattern), name).otherwise(chosen)
    return chosen


def _error(name: str, kind: str, **values) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(MESSAGES[kind].format(name=name, **values)).alias("message"))


def _when(test: Column, error: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), error)


def _constraints(spec: SchemaField, value: Column) -> list[Column]:
    limits = spec.constraints

    def check(kind: str, test) -> list[Column]:
        if kind not in limits:
            return []
        return [_when(test(limits[kind]), _error(spec.name, kind, bound=limits[kind]))]

    if spec.type == "String":
        return [
            *check("minLength", lambda b: F.length(value) < b), *check("maxLength", lambda b: F.length(value) > b),
            *check("pattern", lambda b: ~value.rlike(b)), *check("enum", lambda b: ~value.isin([str(v) for v in b])),
        ]
    if spec.type in ("Integer", "Decimal"):
        return [*check("minimum", lambda b: value < F.lit(b)), *check("maximum", lambda b: value > F.lit(b))]
    if spec.type == "Array":
        return [*check("minItems", lambda b: F.size(value) < b), *check("maxItems", lambda b: F.size(value) > b)]
    return []


def _field_errors(spec: SchemaField, dtype: T.DataType) -> list[Column]:
    value = field(spec.name)
    if isinstance(dtype, T.VariantType):
        described = F.schema_of_variant(value)
        present = value.isNotNull() & (described != "VOID")
        fits = described.rlike(_VARIANT_TYPES[spec.type])
        wrong = F.struct(F.lit(spec.name).alias("field"), F.concat(
            F.lit(MESSAGES["type"].format(name=spec.name, expected=spec.type, actual="")), described).alias("message"))
        errors = [_when(present & ~fits, wrong)]
        cast = _CASTS.get(spec.type) or ("array<variant>" if spec.type == "Array" else None)
        if cast and spec.constraints:
            errors += _constraints(spec, F.when(fits, F.try_variant_get(value, "$", cast)))
        return errors
    if not isinstance(dtype, FIELD_TYPES[spec.type]):
        return [_when(value.isNotNull(), _error(spec.name, "type", expected=spec.type, actual=type_name(dtype)))]
    return _constraints(spec, value)


def schema_errors(df: DataFrame, schema: DataSchema) -> Column:
    """``array<struct<field,message>>`` for each row: required fields first, then the columns in order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    declared = {f.name: f for f in schema.fields}
    found: list[Column] = []
    for spec in schema.fields:
        if spec.required:
            missing = field(spec.name).isNull() if spec.name in types else F.lit(True)
            found.append(_when(missing, _error(spec.name, "required")))
    for name, dtype in types.items():
        if name in declared:
            found.extend(_field_errors(declared[name], dtype))
        elif not schema.allow_unknown:
            found.append(_error(name, "unknown"))
    if not found:
        return F.array().cast(T.ArrayType(ERROR))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def validate(df: DataFrame, schema: DataSchema, target: str = "errors") -> DataFrame:
    """Rows with their error list."""
    return df.select("*", schema_errors(df, schema).alias(target))


def error_list(df: DataFrame, schema: DataSchema, keys: list[str]) -> DataFrame:
    """One output row per error: the key columns, field and message."""
    return unnest(df, keys, schema_errors(df, schema), "field")
