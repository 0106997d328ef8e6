"""Stored sketches of a table's columns, which add up.

One row per part (such as a day) and column holds counts, extremes and three sketches: distinct values (HyperLogLog),
quantiles of numbers (KLL) and frequent values (top-k). A new part costs a pass over its own rows alone; the whole table,
or any span of parts, is described by merging rows that are a few kilobytes each. The sketches are Spark's own, combined
before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import NUMERIC, as_text, field

HLL_BITS = 14        # about 0.8 % error of distinct counts
KLL_K = 800          # about 0.4 % error of ranks
TOP_TRACKED = 10_000  # values tracked; counts are exact while a column has no more distinct ones


def build(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """by..., column, row_count, null_count, low, high (numbers), distinct, numbers, frequent (sketches).

    Values are told apart by their text; a column that is not numeric has no ``numbers``, low and high. NaN counts as a
    value but is no number. Without rows there is no row, without values the sketches are empty.
    """
    by = by or []
    columns = columns or [c for c in df.columns if c not in by]

    def described(name: str) -> Column:
        dtype = df.schema[name].dataType
        value = as_text(field(name), dtype)
        number = field(name).cast("double") if isinstance(dtype, NUMERIC) else F.lit(None).cast("double")
        number = F.when(~F.isnan(number), number)
        return F.struct(
            F.lit(name).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count_if(field(name).isNull()).alias("null_count"),
            F.min(number).alias("low"), F.max(number).alias("high"), F.hll_sketch_agg(value, F.lit(HLL_BITS)).alias("distinct"),
            F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias("numbers"),
            F.call_function("approx_top_k_accumulate", value, F.lit(TOP_TRACKED)).alias("frequent"))

    # no rows of one part: an aggregate without keys would describe an empty table
    grouped = df.groupBy(*[field(b) for b in by]).agg(F.count(F.lit(1)).alias("__n"), F.array(*map(described, columns)).alias("__columns"))
    return grouped.filter("__n > 0").select(*[field(b) for b in by], F.inline("__columns"))


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of coarser parts: one row per ``by`` and column, in the form that :func:`build` gives.

    A part that is sent again must replace its rows, not stand beside them: they would count twice.
    """
    return sketches.groupBy(*[field(b) for b in by or []], "column").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.hll_union_agg("distinct", F.lit(False)).alias("distinct"),
        F.kll_merge_agg_double("numbers", F.lit(KLL_K)).alias("numbers"),
        F.call_function("approx_top_k_combine", "frequent", F.lit(TOP_TRACKED)).alias("frequent"))


def describe(sketches: DataFrame, probabilities: dict[str, float] | None = None, k: int = 10) -> DataFrame:
    """What sketches say, one row per row of :func:`build` or :func:`merge`: counts, ``unique_count``, one double per
    named probability (null without numbers), and ``top``, an array of (item, count), most frequent first.

    A null is no value and no item.
    """
    parts = [c for c in sketches.columns if c not in (
        "column", "row_count", "null_count", "low", "high", "distinct", "numbers", "frequent")]
    held = F.kll_sketch_get_n_double("numbers") > 0
    # the estimate of frequent values is an aggregate: every row is a group of its own
    told = sketches.groupBy(*[field(b) for b in parts], "column").agg(
        *[F.any_value(c).alias(c) for c in ("row_count", "null_count", "low", "high", "distinct", "numbers")],
        F.call_function("approx_top_k_estimate", F.any_value("frequent"), F.lit(k + 1)).alias("top"))
    return told.select(
        *[field(b) for b in parts], "column", "row_count", "null_count", F.hll_sketch_estimate("distinct").alias("unique_count"), "low", "high",
        *[F.kll_sketch_get_quantile_double(F.when(held, F.col("numbers")), F.lit(float(p))).alias(name)
          for name, p in (probabilities or {"p25": 0.25, "median": 0.5, "p75": 0.75}).items()],
        F.slice(F.filter("top", lambda t: t["item"].isNotNull()), 1, k).alias("top"))
