"""Run-history queries over a table of executions.

Columns: run_id, pipeline_id, status, started_at, ended_at, processed, failed and optionally ``metrics``
(array of struct<name,value>). Statuses: Running, Completed, Failed, Cancelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import field
from millrace.operators.paging import latest_per_key

STATUSES = ("Completed", "Failed", "Running", "Cancelled")


def _newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def by_status(runs: DataFrame, status: str) -> DataFrame:
    return _newest(runs.filter(F.col("status") == status))


def by_pipeline(runs: DataFrame, pipeline_id) -> DataFrame:
    return _newest(runs.filter(F.col("pipeline_id") == F.lit(pipeline_id)))


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each pipeline."""
    return latest_per_key(runs, ["pipeline_id"], ["started_at", "run_id"])


def in_range(runs: DataFrame, start=None, end=None, now: Column | None = None) -> DataFrame:
    """Runs started in [start, end]; without bounds, the 24 hours up to ``now``."""
    now = F.current_timestamp() if now is None else now
    low = F.lit(start) if start is not None else now - F.expr("INTERVAL 24 HOURS")
    high = F.lit(end) if end is not None else now
    return runs.filter(F.col("started_at").between(low, high))


def statistics(runs: DataFrame) -> DataFrame:
    """Seven numbers in one aggregation."""
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_records"))


def due(pipelines: DataFrame, now) -> DataFrame:
    """Idle pipelines whose next run is at or before ``now``."""
    return pipelines.filter((F.col("status") == "Idle") & (F.col("next_run_at") <= F.lit(now)))


def metrics(runs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """run_id and one column per metric name when ``names`` is given, else long form run_id, name, value."""
    long = runs.select("run_id", F.inline("metrics"))
    if names is None:
        return long
    return long.groupBy("run_id").pivot("name", names).agg(F.max("value"))


def with_pipeline(runs: DataFrame, pipelines: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs with pipeline, source and (optional) destination names.

    ``pipelines`` has pipeline_id, name, source_id, destination_id; ``sources`` has source_id, name. The joins
    carry no hint: Spark broadcasts the registries while they are under its size threshold.
    """
    origin = sources.select(field("source_id").alias("__s"), F.col("name").alias("source_name"))
    target = sources.select(field("source_id").alias("__d"), F.col("name").alias("destination_name"))
    named = pipelines.join(origin, F.col("source_id") == F.col("__s")) \
        .join(target, F.col("destination_id") == F.col("__d"), "left") \
        .select(F.col("pipeline_id").alias("__p"), F.col("name").alias("pipeline_name"), "source_name",
                "destination_name")
    return runs.join(named, F.col("pipeline_id") == F.col("__p")).drop("__p")


def find(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def count(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    return find(df, predicate).agg(F.count(F.lit(1)).alias("count"))


def exists(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    """One row, one boolean; reads only until the first match."""
    return find(df, predicate).select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("exists"))
