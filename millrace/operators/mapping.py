"""Field mapping: the output holds only the mapped fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import as_text, field, parse_double, parse_int, trimmed


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    required: bool = False
    transformation: str | None = None

    @classmethod
    def from_dict(cls, spec: dict) -> "Mapping":
        return cls(spec["source"], spec["target"], bool(spec.get("required")), spec.get("transformation"))


def _mapped(value: Column, dtype: T.DataType, transformation: str | None) -> Column:
    if not transformation:
        return value
    text = F.coalesce(as_text(value, dtype, ("true", "false")), F.lit(""))
    known = {"uppercase": F.upper, "lowercase": F.lower, "trim": trimmed,
             "parseInt": parse_int, "parseDouble": parse_double}
    return known.get(transformation, lambda t: t)(text)


def apply_mapping(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """Project the mappings; a null required field drops the row, a missing required column drops them all."""
    mappings = [m if isinstance(m, Mapping) else Mapping.from_dict(m) for m in mappings]
    types = {f.name: f.dataType for f in df.schema.fields}
    output: dict[str, Column] = {}
    for m in mappings:
        if m.source in types:
            if m.required:
                df = df.filter(field(m.source).isNotNull())
            output[m.target] = _mapped(field(m.source), types[m.source], m.transformation)
        elif m.required:
            df = df.filter(F.lit(False))
    return df.select(*[column.alias(name) for name, column in output.items()])
