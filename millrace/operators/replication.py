"""Replicating tables: full, by keys, by high-water mark, by change log, and all tables of a source."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.columns import field
from millrace.operators import changes, consistency

log = logging.getLogger(__name__)
DEFAULT_TRACKING = "LastModified"
POOL = "spark.scheduler.pool"


def full(source: DataFrame, destination: DataFrame | None = None) -> DataFrame:
    """New destination content: the source, in the destination's columns where one is given."""
    if destination is None:
        return source
    return source.select(*[field(c).cast(destination.schema[c].dataType).alias(c) if c in source.columns
                           else F.lit(None).cast(destination.schema[c].dataType).alias(c) for c in destination.columns])


def by_keys(source: DataFrame, destination: DataFrame, keys: list[str]) -> DataFrame:
    """New destination content: an upsert on the keys."""
    if not keys:
        raise ValueError("incremental replication needs key columns")
    return consistency.upsert(source, destination, keys)


def new_rows(source: DataFrame, destination: DataFrame, tracking: str = DEFAULT_TRACKING) -> DataFrame:
    """Rows to append: tracking value above the destination's highest, or all when it has none.

    The high-water mark is read first (one value), so it is pushed down to the source scan. Rows are not
    deduplicated.
    """
    mark = destination.agg(F.max(field(tracking)).alias("mark")).first()["mark"]
    return source if mark is None else source.filter(field(tracking) > F.lit(mark))


def by_high_water_mark(source: DataFrame, destination: DataFrame, tracking: str = DEFAULT_TRACKING) -> DataFrame:
    """New destination content: what it holds plus :func:`new_rows`."""
    return destination.unionByName(new_rows(source, destination, tracking), allowMissingColumns=True)


def by_changes(destination: DataFrame, change_log: DataFrame, keys: list[str]) -> DataFrame:
    """New destination content: the change log applied."""
    return changes.apply(destination, change_log, keys)


def all_tables(spark: SparkSession, sources: dict[str, DataFrame], load: Callable[[str, DataFrame], int],
               excluded: list[str] | None = None, at_once: int = 4) -> DataFrame:
    """Load every table but the excluded ones; rows per table, -1 where it failed. One failure stops nothing.

    ``at_once`` tables are loaded at a time, so that the last tasks of one do not leave the cluster idle. Each load is
    a thread with the caller's local properties and a scheduler pool of its own name, which the fair scheduler
    (``spark.scheduler.mode``) gives equal shares. ``load`` must not share state between calls.
    """
    if at_once < 1:
        raise ValueError("at least one table must be loaded at a time")
    skipped = {e.lower() for e in excluded or []}
    names = [name for name in sources if name.lower() not in skipped]
    context = spark.sparkContext

    def copy(name: str) -> tuple[str, int]:
        before = context.getLocalProperty(POOL)
        context.setLocalProperty(POOL, f"replicate-{name}")
        try:
            return name, int(load(name, sources[name]))
        except Exception as problem:  # noqa: BLE001 - a failed table is reported, not raised
            log.error("replication of %s failed: %s", name, problem)
            return name, -1
        finally:
            context.setLocalProperty(POOL, before)  # the thread takes the next table

    with ThreadPoolExecutor(min(at_once, len(names) or 1), "replicate") as pool:
        # each call takes the caller's local properties along
        copies = [pool.submit(inheritable_thread_target(spark)(lambda name=name: copy(name))) for name in names]
        results = [c.result() for c in copies]
    return spark.createDataFrame(results, "table string, row_count bigint")
