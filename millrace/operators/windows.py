"""Window functions over (partition fields, order fields), ascending with nulls first.

Ranking, lead and lag follow the order; running aggregates use the RANGE frame up to the current row;
aggregates without an order, and First/LastValue, see the whole partition.

Partitions of ordinary size use Spark's window operator. A partition too large for one task is laid out in
sorted chunks over many tasks (``repartitionByRange``, written to the shared folder), each chunk works on its
own rows, and a small per-chunk summary carries the totals forward. Results are exact either way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions.columns import field
from millrace.operators import skew
from millrace.session import materialize

RANKING = ("RowNumber", "Rank", "DenseRank")
SHIFTING = ("Lead", "Lag")
EDGES = ("FirstValue", "LastValue")
AGGREGATES = {"Sum": F.sum, "Average": F.avg, "Min": F.min, "Max": F.max, "Count": F.count}


def _ordered(order_by: list[str]) -> list[Column]:
    return [field(o).asc_nulls_first() for o in order_by]


def _plain(function: str, partition_by: list[str], order_by: list[str], source: str | None) -> Column:
    window = Window.partitionBy(*[field(p) for p in partition_by])
    value = field(source) if source else None
    if function in RANKING:
        ranking = {"RowNumber": F.row_number, "Rank": F.rank, "DenseRank": F.dense_rank}
        return ranking[function]().over(window.orderBy(*_ordered(order_by)))
    if function in SHIFTING:
        return {"Lead": F.lead, "Lag": F.lag}[function](value, 1).over(window.orderBy(*_ordered(order_by)))
    if function in EDGES:
        whole = window.orderBy(*_ordered(order_by)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return {"FirstValue": F.first, "LastValue": F.last}[function](value).over(whole)
    subject = value if value is not None else F.lit(1)
    if not order_by:
        return AGGREGATES[function](subject).over(window)
    running = window.orderBy(*_ordered(order_by)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return AGGREGATES[function](subject).over(running)


def apply_window(df: DataFrame, function: str, partition_by: list[str], order_by: list[str], target: str,
                 source: str | None = None, expression: str | None = None,
                 max_group_rows: int = skew.MAX_GROUP_ROWS, heavy: skew.Heavy | None = None,
                 rows_between: tuple[int, int] | None = None) -> DataFrame:
    """Add ``target`` computed by a window function.

    Rows that tie in the order fields are ranked, numbered and shifted among themselves in no fixed order, and a large
    partition may order them differently from a small one: end the order fields with a unique one where it matters.
    ``heavy`` takes the large partitions where the caller knows them. A Custom expression without a window of its own
    is put over the partition, and over its running frame if there are order fields; a large partition is not split
    for it.

    ``rows_between`` (a, b) gives an aggregate or a Custom expression the frame of rows from a to b around each row, negative
    before it: ``ROWS BETWEEN``. Such a frame needs order fields, and splits a large partition (see :func:`framed`).
    """
    if rows_between is not None:
        if function != "Custom" and function not in AGGREGATES:
            raise ValueError(f"{function} takes no frame of rows")
        if not order_by or rows_between[0] > rows_between[1]:
            raise ValueError("a frame of rows needs order fields, and an end that is not before its start")
        if function == "Custom":
            value = F.expr(expression)
        elif source is None and function != "Count":
            raise ValueError(f"{function} needs a source field")
        else:
            value = AGGREGATES[function](field(source) if source else F.lit(1))
        return framed(df, partition_by, order_by, target, value, *rows_between, max_group_rows, heavy)
    if function == "Custom":
        return df.withColumn(target, _custom(df, expression, partition_by, order_by))
    known = RANKING + SHIFTING + EDGES + tuple(AGGREGATES)
    if function not in known:
        raise ValueError(f"unknown window function {function!r}")
    if function in RANKING + SHIFTING + EDGES and not order_by:
        raise ValueError(f"{function} needs order fields")
    if function not in RANKING and function != "Count" and source is None:
        raise ValueError(f"{function} needs a source field")
    if heavy is None:
        heavy = skew.heavy_groups(df, partition_by, max_group_rows)
    if not heavy:
        return df.withColumn(target, _plain(function, partition_by, order_by, source))
    ordinary, large = skew.split_heavy(df, partition_by, heavy)
    narrow = ordinary.withColumn(target, _plain(function, partition_by, order_by, source))
    wide = _large(large, function, partition_by, order_by, target, source, max_group_rows, heavy)
    wide = wide.select(*[field(c).cast(narrow.schema[c].dataType).alias(c) if c == target else field(c)
                         for c in narrow.columns])
    return narrow.unionByName(wide) if partition_by else wide


def framed(df: DataFrame, partition_by: list[str], order_by: list[str], target: str, value: Column, start: int, end: int,
           max_group_rows: int = skew.MAX_GROUP_ROWS, heavy: skew.Heavy | None = None) -> DataFrame:
    """Add ``value`` (any aggregate or window expression) over the rows from ``start`` to ``end`` around each row.

    The rows of a large partition are numbered and cut into tiles of ``max_group_rows`` rows, or of the frame's width if
    that is more. Each tile also gets copies of the neighbours that frames of its rows reach beyond its edges, at most
    two copies of a row in all, so every tile computes its own rows alone. Copies are dropped afterwards.
    """
    if heavy is None:
        heavy = skew.heavy_groups(df, partition_by, max_group_rows)
    parts = [field(p) for p in partition_by]

    def over(rows: DataFrame, keys: list, order: list) -> DataFrame:
        return rows.withColumn(target, value.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, end)))

    if not heavy:
        return over(df, parts, _ordered(order_by))
    ordinary, large = skew.split_heavy(df, partition_by, heavy)
    before, after = max(0, -start), max(0, end)
    size = max(max_group_rows, before + after, 1)
    numbered = number_rows(large, partition_by, order_by, "__n", max_group_rows).withColumn("__n", F.col("__n") - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("__n") - after) / size))
    dealt = numbered.withColumn("__tile", F.explode(F.sequence(first.cast("bigint"), F.floor((F.col("__n") + before) / size).cast("bigint"))))
    own = F.floor(F.col("__n") / size) == F.col("__tile")
    wide = over(dealt, [*parts, F.col("__tile")], [F.col("__n")]).filter(own).drop("__n", "__tile")
    narrow = over(ordinary, parts, _ordered(order_by))
    return narrow.unionByName(wide.select(*[field(c) for c in narrow.columns])) if partition_by else wide


def _custom(df: DataFrame, expression: str, partition_by: list[str], order_by: list[str]) -> Column:
    if not (partition_by or order_by) or re.search(r"\bover\s*\(", expression, re.IGNORECASE):
        return F.expr(expression)
    window = Window.partitionBy(*[field(p) for p in partition_by])
    return F.expr(expression).over(window.orderBy(*_ordered(order_by)) if order_by else window)


def _large(df: DataFrame, function: str, partition_by: list[str], order_by: list[str], target: str,
           source: str | None, max_group_rows: int, heavy: skew.Heavy) -> DataFrame:
    if function == "RowNumber":
        return number_rows(df, partition_by, order_by, target, max_group_rows)
    if function in SHIFTING:
        return _shifted(df, function, partition_by, order_by, target, source, max_group_rows)
    if function in EDGES or not order_by:
        subject = field(source) if source else F.lit(1)
        if function in EDGES:
            place = F.struct(*[field(o) for o in order_by])
            value = (F.min_by if function == "FirstValue" else F.max_by)(subject, place)
        else:
            value = AGGREGATES[function](subject)
        totals = df.groupBy(*[field(p) for p in partition_by]).agg(value.alias(target))
        if not partition_by:
            return df.crossJoin(F.broadcast(totals))  # one row
        return skew.join_per_key(df, totals, partition_by, "left", heavy=heavy)
    return _by_order_value(df, function, partition_by, order_by, target, source, max_group_rows)


def _layout(df: DataFrame, partition_by: list[str], order_by: list[str], max_group_rows: int) -> DataFrame:
    """Rows in sorted chunks with a stable position ``__pos``; its high bits are the chunk ``__chunk``.

    A number of the row's own breaks ties, so a pile of equal rows spreads over chunks as well. Writing the layout
    to the shared folder fixes the positions before they are read twice.
    """
    rows = skew.numbered(df, "__tie")
    chunks = max(2, -(-rows.count() // max_group_rows))
    by = [field(c).asc_nulls_first() for c in partition_by + order_by] + [F.col("__tie").asc()]
    laid = rows.repartitionByRange(chunks, *by).sortWithinPartitions(*by) \
        .withColumn("__pos", F.monotonically_increasing_id()).drop("__tie")
    return materialize(laid).withColumn("__chunk", F.shiftright("__pos", 33))


def _carry_join(rows: DataFrame, summary: DataFrame, partition_by: list[str]) -> DataFrame:
    """Attach the per-(partition, chunk) summary. It has a row per chunk and heavy partition, each standing for
    ``max_group_rows`` rows or so, is written, and is broadcast if its count is small."""
    summary = materialize(summary)
    if summary.count() <= skew.MAX_BROADCAST_GROUPS:
        summary = F.broadcast(summary)
    return skew.join_per_key(rows, summary, partition_by + ["__chunk"], "left", heavy=skew.NONE)


def number_rows(df: DataFrame, partition_by: list[str], order_by: list[str], target: str,
                max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Row numbers from 1 in each partition, computed chunk by chunk."""
    laid = _layout(df, partition_by, order_by, max_group_rows)
    chunk_of = [field(p) for p in partition_by] + [F.col("__chunk")]
    before = Window.partitionBy(*[field(p) for p in partition_by]).orderBy("__chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        laid.groupBy(*chunk_of).agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__carry", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    numbered = _carry_join(laid, summary, partition_by)
    position = F.col("__pos") - F.col("__start") + F.col("__carry") + 1
    return numbered.withColumn(target, position).drop("__pos", "__chunk", "__start", "__carry")


def _shifted(df: DataFrame, function: str, partition_by: list[str], order_by: list[str], target: str,
             source: str, max_group_rows: int) -> DataFrame:
    laid = _layout(df, partition_by, order_by, max_group_rows)
    parts = [field(p) for p in partition_by]
    local = Window.partitionBy(*parts, "__chunk").orderBy("__pos")
    shift = {"Lead": F.lead, "Lag": F.lag}[function]
    # a struct tells "no neighbour in this chunk" from "the neighbour's value is null"
    inside = laid.withColumn("__near", shift(F.struct(field(source).alias("v")), 1).over(local))
    edge = F.max_by if function == "Lag" else F.min_by
    across = Window.partitionBy(*parts).orderBy("__chunk")
    summary = (
        laid.groupBy(*parts, "__chunk").agg(edge(F.struct(field(source).alias("v")), "__pos").alias("__edge"))
        .withColumn("__far", shift("__edge", 1).over(across))
        .drop("__edge")
    )
    joined = _carry_join(inside, summary, partition_by)
    value = F.when(F.col("__near").isNotNull(), F.col("__near.v")).otherwise(F.col("__far.v"))
    return joined.withColumn(target, value).drop("__pos", "__chunk", "__near", "__far")


def _by_order_value(df: DataFrame, function: str, partition_by: list[str], order_by: list[str], target: str,
                    source: str | None, max_group_rows: int) -> DataFrame:
    """Rank, DenseRank and running aggregates depend only on (partition, order value): collapse to those
    first, scan the collapsed rows chunk by chunk, and join the answer back."""
    keys = partition_by + order_by
    value = field(source) if source else F.lit(1)
    groups = df.groupBy(*[field(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__rows"),
        *({"Sum": [F.sum(value).alias("__v")], "Min": [F.min(value).alias("__v")], "Max": [F.max(value).alias("__v")],
           "Count": [F.count(value).alias("__v")],
           "Average": [F.sum(value).alias("__v"), F.count(value).alias("__c")]}.get(function, [])),
    )
    laid = _layout(groups, partition_by, order_by, max_group_rows)
    parts = [field(p) for p in partition_by]
    running = Window.partitionBy(*parts, "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*parts).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)

    def scan(name: str, fold, total) -> tuple[Column, Column, Column]:
        """(local running value, chunk total, carry from earlier chunks)"""
        return (fold(name).over(running).alias(f"{name}_local"), fold(name).alias(f"{name}_total"),
                total(f"{name}_total").over(earlier).alias(f"{name}_carry"))

    wanted = {"Rank": ["__rows"], "DenseRank": ["__one"], "Average": ["__v", "__c"]}.get(function, ["__v"])
    fold = {"Min": F.min, "Max": F.max}.get(function, F.sum)
    if function == "DenseRank":
        laid = laid.withColumn("__one", F.lit(1).cast("bigint"))
    scans = {name: scan(name, fold, fold) for name in wanted}
    local = laid.select("*", *[s[0] for s in scans.values()])
    summary = laid.groupBy(*parts, "__chunk").agg(*[s[1] for s in scans.values()]) \
        .select(*parts, "__chunk", *[s[2] for s in scans.values()])
    joined = _carry_join(local, summary, partition_by)

    def combined(name: str) -> Column:
        inner, carry = F.col(f"{name}_local"), F.col(f"{name}_carry")
        if function in ("Min", "Max"):
            return (F.least if function == "Min" else F.greatest)(inner, carry)
        return F.when(inner.isNull() & carry.isNull(), None) \
            .otherwise(F.coalesce(inner, F.lit(0)) + F.coalesce(carry, F.lit(0)))

    if function == "Rank":
        answer = combined("__rows") - F.col("__rows") + 1
    elif function == "DenseRank":
        answer = combined("__one")
    elif function == "Average":
        exact = isinstance(groups.schema["__v"].dataType, T.DecimalType)
        answer = F.try_divide(combined("__v") if exact else combined("__v").cast("double"),
                              combined("__c").cast("decimal(20,0)") if exact else combined("__c"))
    else:
        answer = combined("__v")
    answers = joined.select(*[field(k) for k in keys], answer.alias(target))
    return skew.join_per_key(df, answers, keys, "left", max_group_rows=max_group_rows)
