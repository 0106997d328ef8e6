"""Grouped aggregation in two forms.

``summarize`` follows the record processor: values that do not parse as numbers are ignored, an empty input
gives no row even without group keys, unknown functions give 0. ``aggregate`` takes named aggregate functions,
including First and Last (by an order column), exact Median, Quantile and Mode, and SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import all_of, field, numeric_value, same
from millrace.operators import quantiles, skew

RANKED = ("Median", "Quantile", "Mode")


@dataclass(frozen=True)
class Measure:
    """One output of :func:`summarize`: sum, avg, min, max or count of a field."""

    field: str
    function: str
    output: str | None = None


@dataclass(frozen=True)
class Agg:
    """One output of :func:`aggregate`."""

    function: str                      # Count, Sum, Min, Max, Average, First, Last, Custom, Median, Quantile, Mode
    field: str | None = None
    expression: str | Column | None = None   # SQL text, or a column such as a grouped-aggregate pandas UDF
    order: tuple[str, ...] = ()
    probability: float | None = None         # of a Quantile


def _measure(df: DataFrame, m: Measure) -> Column:
    function = m.function.lower()
    value = numeric_value(df, m.field) if m.field in df.columns else F.lit(None).cast("double")
    if function == "count":
        return F.count(value)
    known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if function in known:
        return known[function](value)
    return F.when(F.count(value) > 0, F.lit(0))


def summarize(df: DataFrame, group_by: list[str], measures: list[Measure]) -> DataFrame:
    """Aggregate the numeric values of each group; group keys keep their types and nulls form one group."""
    measures = [m if isinstance(m, Measure) else Measure(**m) for m in measures]
    outputs = [_measure(df, m).alias(m.output or f"{m.function}_{m.field}")
               for m in measures if m.field and m.function]
    keys = [field(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in group_by]
    if keys:
        return df.groupBy(*keys).agg(*outputs) if outputs else df.select(*keys).distinct()
    rows = df.agg(F.count(F.lit(1)).alias("__rows"), *outputs)
    return rows.filter("__rows > 0").drop("__rows")


def agg_column(agg: Agg, default_order: tuple[str, ...] = ()) -> Column:
    if agg.function == "Count" and agg.field is None:
        return F.count(F.lit(1))
    if agg.function == "Custom":
        return F.expr(agg.expression) if isinstance(agg.expression, str) else agg.expression
    value = field(agg.field)
    simple = {"Count": F.count, "Sum": F.sum, "Min": F.min, "Max": F.max, "Average": F.avg}
    if agg.function in simple:
        return simple[agg.function](value)
    order = agg.order or default_order
    if agg.function not in ("First", "Last"):
        raise ValueError(f"unknown aggregate {agg.function!r}")
    if not order:
        raise ValueError(f"{agg.function} needs an order column")
    key = F.struct(*[field(o) for o in order])
    # the struct keeps rows whose value is null in play: min_by skips only null order keys
    return (F.min_by if agg.function == "First" else F.max_by)(value, key)


def aggregate(df: DataFrame, group_by: list[str], outputs: dict[str, Agg], max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Group and compute named outputs; without keys an empty input gives no row.

    Medians, quantiles and modes are exact (see ``quantiles``) and split a group above ``max_group_rows``.
    """
    ranked = {name: a for name, a in outputs.items() if a.function in RANKED}
    if ranked:
        return _joined(_parts(df, group_by, outputs, ranked, max_group_rows), group_by).select(
            *[field(k) for k in group_by], *[field(n) for n in outputs])
    columns = [agg_column(a).alias(name) for name, a in outputs.items()]
    if group_by:
        return df.groupBy(*[field(k) for k in group_by]).agg(*columns)
    rows = df.agg(F.count(F.lit(1)).alias("__rows"), *columns)
    return rows.filter("__rows > 0").drop("__rows")


def _parts(df: DataFrame, group_by: list[str], outputs: dict[str, Agg], ranked: dict[str, Agg], max_group_rows: int) -> list[DataFrame]:
    """Tables with one row per group, which together hold all outputs."""
    plain = {name: a for name, a in outputs.items() if name not in ranked}
    parts = [aggregate(df, group_by, plain)] if plain else []
    by_source: dict[str, dict[str, float]] = {}
    for name, a in ranked.items():
        if a.function == "Mode":
            parts.append(quantiles.grouped_modes(df, group_by, a.field, name))
        elif a.function == "Quantile" and a.probability is None:
            raise ValueError("Quantile needs a probability")
        else:
            by_source.setdefault(a.field, {})[name] = 0.5 if a.function == "Median" else a.probability
    return parts + [quantiles.grouped_quantiles(df, group_by, source, wanted, max_group_rows) for source, wanted in by_source.items()]


def _joined(parts: list[DataFrame], group_by: list[str]) -> DataFrame:
    """Tables with the same groups, joined by their keys; without keys each has the one row or none."""
    out = parts[0]
    for part in parts[1:]:
        for i, k in enumerate(group_by):
            part = part.withColumnRenamed(k, f"__key_{i}")
        met = all_of([same(out[f"`{k}`"], part[f"__key_{i}"]) for i, k in enumerate(group_by)]) if group_by else F.lit(True)
        out = out.join(part, met).drop(*[f"__key_{i}" for i in range(len(group_by))])
    return out
