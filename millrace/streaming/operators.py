"""Structured Streaming operators: rules, tumbling windows, windowed joins, micro-batches, change subscription."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.columns import field
from millrace.operators.aggregates import Agg, agg_column
from millrace.operators.rules import Rule, apply_rules
from millrace.streaming.targets import ChangeTarget


def transform(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """Apply a rule list; stateless, the same plan as in batch."""
    return apply_rules(stream, rules)


def window_aggregate(stream: DataFrame, time: str, size: str, group_by: str | None, outputs: dict[str, Agg],
                     delay: str) -> DataFrame:
    """Tumbling windows aligned to the epoch: window_start, window_end, the group field and the outputs.

    Rows later than ``delay`` behind the newest event time are dropped, and a window is emitted once it can no
    longer change. First and Last go by event time unless they name another order.
    """
    marked = stream.withWatermark(time, delay) if stream.isStreaming else stream
    keys = [F.window(field(time), size).alias("window")] + ([field(group_by)] if group_by else [])
    grouped = marked.groupBy(*keys).agg(*[agg_column(a, (time,)).alias(n) for n, a in outputs.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          *([field(group_by)] if group_by else []), *[field(n) for n in outputs])


def join_streams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str,
                 within: str, delay: str, tiles: int = 1) -> DataFrame:
    """Inner equi-join of rows at most ``within`` apart; both watermarks bound the join state.

    Clashing right columns get a ``right_`` prefix. For keys that hold a large share of a stream, ``tiles`` spreads
    the left rows of each key over that many tasks and repeats the right rows in each of them.
    """
    taken = set(left.columns)
    names = {c: (f"right_{c}" if c in taken else c) for c in right.columns}
    right = right.select(*[field(c).alias(n) for c, n in names.items()])
    r_key, r_time = names[right_key], names[right_time]
    if left.isStreaming:
        left, right = left.withWatermark(left_time, delay), right.withWatermark(r_time, delay)
    span = F.expr(f"INTERVAL {within}")
    met = (field(left_key) == field(r_key)) & (field(r_time) >= field(left_time) - span) \
        & (field(r_time) <= field(left_time) + span)
    if tiles == 1:
        return left.join(right, met, "inner")
    # the tile is a function of the row, so a replayed row meets the same state
    left = left.withColumn("__lt", F.pmod(F.xxhash64(*[field(c) for c in left.columns]), F.lit(tiles)).cast("int"))
    right = right.withColumn("__rt", F.explode(F.array(*[F.lit(i) for i in range(tiles)])))
    return left.join(right, met & (F.col("__lt") == F.col("__rt")), "inner").drop("__lt", "__rt")


def process_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Hand every micro-batch to ``handle(df, batch_id)``. A batch may be handed over again after a failure, so
    the handler should write under the batch id or be idempotent."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def subscribe_changes(log: DataFrame, target: ChangeTarget, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes to a target. A change applied twice changes nothing more, a late change never undoes a
    newer one, and what is written follows the changed keys."""
    return target.subscribe(log, checkpoint, available_now)
