"""Pivot and unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions.columns import field
from millrace.operators.aggregates import RANKED, Agg, agg_column, aggregate


def pivot(df: DataFrame, row_fields: list[str], column_field: str, value_field: str | None = None, function: str = "Sum",
          values: list | None = None, order: tuple[str, ...] | list[str] = (), expression: str | None = None,
          probability: float | None = None) -> DataFrame:
    """Rows to columns by any aggregate function; First and Last need ``order``, Custom an ``expression``, Quantile
    a ``probability``.

    Pass ``values`` to save the pass that looks up the distinct column values; without them Spark stops at
    ``spark.sql.pivotMaxValues``.
    """
    agg = Agg(function, value_field, order=tuple(order), expression=expression, probability=probability)
    if function in RANKED:
        # one row per cell first, by a plan that splits large cells
        df = aggregate(df, [*row_fields, column_field], {"__cell": agg})
        cell = F.first("__cell")
    else:
        cell = agg_column(agg)
    return df.groupBy(*[field(r) for r in row_fields]).pivot(column_field, values).agg(cell)


def unpivot(df: DataFrame, key_fields: list[str], value_fields: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows; null values are kept."""
    return df.unpivot([field(k) for k in key_fields], [field(v) for v in value_fields], name, value)
