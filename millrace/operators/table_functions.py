"""Table functions: ordered folds over groups of rows, and linear models per group.

Both are Python UDTFs whose result columns depend on their arguments. A fold takes a table with ``PARTITION BY`` and
``ORDER BY``; a model's solver is called laterally, once per group, on sums that Spark has added up.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from millrace.functions.columns import field
from millrace.operators import skew, windows

# -- folds ------------------------------------------------------------------------------------------------------


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold_groups(df: DataFrame, keys: list[str], order_by: list[str], make: Callable[[], Callable[[Row], tuple]], outputs: str,
                begins: Column | None = None, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add columns that depend on all earlier rows of a row's group.

    ``make`` is called once per group and returns a function that is given the group's rows in ascending order, nulls
    first, and returns the values of ``outputs`` (a DDL string) for each. Rows that tie come in no fixed order. Null keys
    are a group. A group passes through one task row by row, so its size takes time but no memory.

    ``begins`` tells of a row that what follows does not depend on what comes before it: true where the function's state
    may be made anew, computed from the row and from ``__previous`` (a struct of the row before's order fields, null at a
    group's start). The group is cut there, and its pieces go to different tasks. Rows that tie share a piece.
    """
    added = T.StructType.fromDDL(outputs)
    clash = {f.name for f in added} & set(df.columns)
    if clash or not order_by:
        raise ValueError(f"the result has columns of the input: {sorted(clash)}" if clash else "a fold needs order fields")
    pieces, parts = df, list(keys)
    if begins is not None:
        pieces, parts = _cut(df, keys, order_by, begins, max_group_rows), [*keys, "__piece"]
    kept = list(df.columns)

    class Fold:
        @staticmethod
        def analyze(rows: AnalyzeArgument, partition_by: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
            inputs = [f for f in rows.dataType.fields if f.name in kept]
            names = json.loads(partition_by.value)
            return AnalyzeResult(
                T.StructType([*inputs, *added.fields]), withSinglePartition=not names,
                partitionBy=[PartitioningColumn(n) for n in names],
                orderBy=[OrderingColumn(n, ascending=True, overrideNullsFirst=True) for n in json.loads(order.value)])

        def __init__(self):
            self.step = None

        def eval(self, row, partition_by, order):
            if self.step is None:
                self.step = make()
            yield (*(row[name] for name in kept), *self.step(row))

    names = [F.lit(json.dumps([_quoted(n) for n in part])) for part in (parts, order_by)]
    return udtf(Fold)(pieces.asTable(), *names)


def _cut(df: DataFrame, keys: list[str], order_by: list[str], begins: Column, max_group_rows: int) -> DataFrame:
    """``__piece``: how many rows up to this one begin a piece of their group; large groups are windowed in chunks."""
    heavy = skew.heavy_groups(df, keys, max_group_rows)
    order = df.withColumn("__order", F.struct(*[field(o) for o in order_by]))
    shifted = windows.apply_window(order, "Lag", keys, order_by, "__previous", "__order", heavy=heavy, max_group_rows=max_group_rows)
    marked = shifted.withColumn("__begins", F.coalesce(begins, F.lit(False)).cast("int"))
    numbered = windows.apply_window(marked, "Sum", keys, order_by, "__piece", "__begins", heavy=heavy, max_group_rows=max_group_rows)
    return numbered.drop("__order", "__previous", "__begins")


def sessions(df: DataFrame, keys: list[str], time: str, idle: float, longest: float, target: str = "session_start",
             max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add the time at which a row's session began.

    A session ends after ``idle`` seconds without a row, and a row later than ``longest`` seconds after its start begins
    the next one. The second rule depends on every earlier session, so no window function can state it. A pause of more
    than ``idle`` seconds ends a session in any case: groups are cut there. Rows without a time have no session.
    """
    clock = "__micros"

    def make():
        start = last = None

        def step(row) -> tuple:
            nonlocal start, last
            now = row[clock]
            if now is not None:
                if start is None or now - last > quiet or now - start > span:
                    start = now
                last = now
            return (start,)

        return step

    quiet, span = round(idle * 1_000_000), round(longest * 1_000_000)
    dtype = df.schema[time].dataType
    timed = df.withColumn(clock, _micros(field(time), dtype))
    pause = F.col(clock) - F.col("__previous")[clock]
    folded = fold_groups(timed, keys, [clock], make, "__start bigint", pause > F.lit(quiet), max_group_rows)
    return folded.select(*[field(c) for c in df.columns if c != target], _from_micros(F.col("__start"), dtype).alias(target))


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970; of a time without a zone by its own calendar, whatever the session's zone."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    since = value.cast("timestamp_ntz") - F.expr(_EPOCH)
    whole = F.extract(F.lit("DAY"), since) * 86_400 + F.extract(F.lit("HOUR"), since) * 3_600 + F.extract(F.lit("MINUTE"), since) * 60
    return whole.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")


def _from_micros(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(value)
    seconds = (value.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return (F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)).cast(dtype)


# -- linear models ----------------------------------------------------------------------------------------------


@udtf
class _Solve:
    """Least squares from means, squares and products: ``intercept``, ``r2`` and one coefficient per feature."""

    @staticmethod
    def analyze(moments: AnalyzeArgument, features: AnalyzeArgument) -> AnalyzeResult:
        names = ["intercept", "r2", *(f"coef_{n}" for n in json.loads(features.value))]
        return AnalyzeResult(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))

    def eval(self, moments, features):
        width = len(json.loads(features))
        means, flat = np.array(moments[:width + 1]), iter(moments[width + 1:])
        cov = np.zeros((width + 1, width + 1))
        for i in range(width + 1):
            for j in range(i, width + 1):
                cov[i, j] = cov[j, i] = next(flat)
        inner, spread = cov[:width, :width], np.sqrt(np.diag(cov))
        scaled = inner / np.outer(spread[:width], spread[:width]) if spread[:width].all() else np.zeros_like(inner)
        if np.linalg.matrix_rank(scaled, tol=1e-10) < width:
            yield (None,) * (width + 2)
            return
        slopes = np.linalg.solve(scaled, cov[:width, width] / spread[:width]) / spread[:width]
        r2 = float(slopes @ cov[:width, width] / cov[width, width]) if cov[width, width] else None
        yield (float(means[width] - slopes @ means[:width]), r2, *map(float, slopes))


def linear_models(df: DataFrame, keys: list[str], label: str, features: list[str]) -> DataFrame:
    """One least-squares model per group: keys, ``n``, ``intercept``, ``r2`` and ``coef_<feature>``.

    Spark adds up means and covariances, combined before the shuffle, so a group of any size is one small row; a table
    function then solves each group's equations. Rows with a null, NaN or infinite value take no part. Without keys the
    whole table is one group, which an empty input does not have. Where the features depend on each other, or there are
    too few rows, the model is null.
    """
    if not features:
        raise ValueError("a model needs features")
    fields = [field(c).cast("double") for c in [*features, label]]
    finite = F.lit(True)
    for value in fields:
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    names = [f"__x{i}" for i in range(len(fields))]
    rows = df.filter(finite).select(*[field(k) for k in keys], *[v.alias(n) for v, n in zip(fields, names)])
    products = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = F.array(*[F.avg(n) for n in names], *products).alias("__moments")
    sums = rows.groupBy(*[field(k) for k in keys]).agg(F.count("*").alias("n"), moments).filter("n > 0")
    return sums.lateralJoin(_Solve(F.col("__moments").outer(), F.lit(json.dumps(features)))).drop("__moments")


def apply_linear_models(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], target: str,
                        max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add each row's prediction by the model of its group; null where there is no model or a feature is null."""
    renamed = models.select(*[field(k) for k in keys], F.struct("intercept", *[field(f"coef_{f}") for f in features]).alias("__model"))
    joined = skew.join_per_key(df, renamed, keys, "left", max_group_rows=max_group_rows, null_safe=True) if keys \
        else df.join(F.broadcast(renamed), how="left")
    value = F.col("__model")["intercept"]
    for feature in features:
        value = value + F.col("__model")[f"coef_{feature}"] * field(feature).cast("double")
    return joined.select(*[field(c) for c in df.columns if c != target], value.alias(target))
