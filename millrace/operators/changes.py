"""Change capture: diffs between snapshots, change logs, and applying changes to a target.

A change log has the columns ``op`` (insert, update, delete), ``ts``, ``txn``, the key columns, and the row
images ``before`` and ``after``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import any_of, field
from millrace.operators import skew
from millrace.operators.consistency import differ, paired


def diff(before: DataFrame, after: DataFrame, keys: list[str], ts: Column, txn: Column | None = None,
         order_by: list[str] | None = None) -> DataFrame:
    """The change log that leads from one snapshot to the next."""
    columns = before.columns
    rest = [c for c in columns if c not in keys]
    pairs = paired(before, after, keys, columns, order_by)
    changed = differ(F.col("src"), F.col("dst"), pairs.schema["src"].dataType, rest)
    op = F.when(F.col("src").isNull(), "insert").when(F.col("dst").isNull(), "delete").when(changed, "update")

    def image(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(*[F.col(side)[c].alias(c) for c in columns]))

    return pairs.withColumn("op", op).filter(F.col("op").isNotNull()).select(
        "op", ts.alias("ts"), (txn if txn is not None else F.lit("")).alias("txn"), *[field(k) for k in keys],
        image("src").alias("before"), image("dst").alias("after"))


def between(log: DataFrame, start=None, end=None) -> DataFrame:
    """Changes with ``start < ts <= end``; an open end is left out."""
    if start is not None:
        log = log.filter(F.col("ts") > F.lit(start))
    return log.filter(F.col("ts") <= F.lit(end)) if end is not None else log


def since_mark(log: DataFrame, marks: DataFrame, table: str) -> DataFrame:
    """Changes after the table's last sync mark; all of them when it has none.

    The mark is read first (one value), so it reaches the log's scan as a filter.
    """
    mark = marks.filter(F.col("table") == table).agg(F.max("mark").alias("mark")).first()["mark"]
    return between(log, mark)


def sync_mark(log: DataFrame, table: str) -> DataFrame:
    """One row (table, mark) to append to the marks table: the newest change of the log."""
    return log.agg(F.lit(table).alias("table"), F.max("ts").alias("mark"))


def latest_changes(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last change per key by time, then transaction."""
    picked = F.max_by(F.struct("op", "after"), F.struct("ts", "txn"))
    return log.groupBy(*[field(k) for k in keys]).agg(picked.alias("__c")) \
        .select(*[field(k) for k in keys], F.col("__c.op").alias("op"), F.col("__c.after").alias("after"))


def apply(target: DataFrame, log: DataFrame, keys: list[str],
          max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """The target after the log: deletes remove, inserts and updates put the after image in place."""
    latest = latest_changes(log, keys)
    untouched = skew.join_per_key(target, latest.select(*[field(k) for k in keys]), keys, "left_anti",
                                  max_group_rows=max_group_rows)
    written = latest.filter(F.col("op") != "delete").select(*[
        F.col("after")[c].alias(c) for c in target.columns])
    return untouched.unionByName(written)


def sync_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted, updated, deleted, and errors (changes whose key is incomplete)."""
    broken = any_of([field(k).isNull() for k in keys])
    kinds = {"inserted": "insert", "updated": "update", "deleted": "delete"}
    return log.agg(*[F.count_if((F.col("op") == op) & ~broken).alias(name) for name, op in kinds.items()],
                   F.count_if(broken).alias("errors"))


def synchronize(target: DataFrame, source: DataFrame, keys: list[str], ts: Column) -> tuple[DataFrame, DataFrame]:
    """(the target brought level with the source, the counts)."""
    log = diff(target, source, keys, ts)
    complete = log.filter(~any_of([field(k).isNull() for k in keys]))
    return apply(target, complete, keys), sync_counts(log, keys)


def table_info(log: DataFrame, table: str) -> DataFrame:
    """One row: table, tracked columns, total changes, last change."""
    tracked = [f.name for f in log.schema["after"].dataType.fields]
    return log.agg(F.lit(table).alias("table"), F.lit(",".join(tracked)).alias("tracked_columns"),
                   F.count(F.lit(1)).alias("total_changes"), F.max("ts").alias("last_change"))
