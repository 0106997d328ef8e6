"""A table kept up to date by a stream of changes, held as keyed state.

The stream groups changes by pages of keys; of each key the state keeps the row of its last change, or only that change's
time if it was a delete. Every change is compared with that time, so changes may arrive late, twice and in any order. Spark's
state store is the table: a batch writes what its keys changed, and the table is the state store read back. A tombstone
expires ``keep_deletes`` after the delete was handled; a change of that key that arrives later still would bring it back.

A query that starts on a new checkpoint takes over the rows and tombstones of the one before it, so nothing that was
applied is lost. The state store must be RocksDB (:func:`millrace.session.build_session` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.errors import AnalysisException

from millrace.functions.columns import field
from millrace.session import new_folder

KEEP_DELETES = timedelta(days=30)
#: Keys of a page of the state when its checkpoint is new, and the least number of pages.
PAGE_KEYS, LEAST_PAGES = 256, 1024
#: Outdated rows that a page may hold besides as many as it has keys.
SPARE = 8
#: Bytes of changes that a task collects to find the newest of each key.
PENDING = 64 << 20
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Rows travel through the state as JSON and times as numbers, so no value meets Python's idea of time zones.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _plain(value: Column, dtype: T.DataType) -> Column:
    """A time as a number; other values as they are."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    return F.unix_date(value) if isinstance(dtype, T.DateType) else value


def _back(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(value).cast(dtype)
    return F.date_from_unix_date(value) if isinstance(dtype, T.DateType) else value


def _order(ts, txn) -> tuple:
    """Orders changes by time, then transaction; nulls first."""
    return (ts is not None, ts) if ts is not None else (False, 0), (txn is not None, txn) if txn is not None else (False, 0)


class _LastChanges(StatefulProcessor):
    """State of a page of keys: a list of segments, each with the last change of some keys (columns as arrays: id, the keys,
    ts, txn, after, until). Of two changes of a key that in the later segment counts; a tombstone has ``until``, after which
    a timer drops it. A visit appends a segment of the keys that it changed; once more than half of the rows are outdated,
    the page is written anew, so what is written follows the changed keys. Every group, and every item that goes to or comes
    from the state, costs a message or a conversion, which the keys of a page share.

    Event time is the time at which a row is handled, so no change is too late to be seen."""

    def __init__(self, segment: T.StructType, keep: timedelta):
        self.segment, self.keep = segment, int(keep.total_seconds() * 1000)
        self.keys = [c for c in segment.names if c.startswith("key_")]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.segment)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._write(self._newer(initialState["rows"], {}).values(), 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        count, newest, number = self._load()
        changed = self._newer(rows, newest)
        if changed:
            newest |= changed
            anew = count + len(changed) > 2 * len(newest) + SPARE
            self._write(*((newest.values(), 0) if anew else (changed.values(), number)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, (_, newest, _) = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        kept = [r for r in newest.values() if r[-1] is None or r[-1] > now]
        if len(kept) < len(newest):
            self._write(kept, 0) if kept else self.held.clear()
        return iter(())

    def _load(self) -> tuple[int, dict, int]:
        """The number of rows held, the one that counts of each key, and the next segment's number (0: there is none)."""
        count, newest, number = 0, {}, 0
        for segment in self.held.get():
            count += len(segment[1])
            newest.update(zip(segment[1], zip(*segment[1:])))
            number = segment[0] + 1
        return count, newest, number

    def _write(self, rows, number: int) -> None:
        """Segment 0 replaces all others."""
        segment = (number, *map(list, zip(*rows)))
        self.held.appendValue(segment) if number else self.held.put([segment])

    def _newer(self, rows, held: dict) -> dict:
        """The keys that rows change, each with its last change."""
        changed = {}
        for r in rows:
            old = changed.get(r["id"]) or held.get(r["id"])
            if old is not None and old[-1] is not None and old[-1] <= r["handled"]:
                old = None
            if old is None or _order(r["ts"], r["txn"]) >= _order(old[-4], old[-3]):
                gone = r["op"] == "delete"
                changed[r["id"]] = (r["id"], *[r[k] for k in self.keys], r["ts"], r["txn"], None if gone else r["after"],
                                    r["handled"] + self.keep if gone else None)
        for until in {r[-1] for r in changed.values()} - {None}:
            self.handle.registerTimer(until)
        return changed

    def close(self) -> None:
        pass


def _newest(keys: list[str]):
    """Of each key of a run of rows only the newest change, so that a key with very many changes is met early. A run ends
    with the input, or when more than half of PENDING bytes are changes of different keys."""

    def reduced(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("ts", "ascending"), ("txn", "ascending")], null_placement="at_start")
        ranked = table.select(keys).take(order).append_column("__at", pa.array(range(len(order)), pa.int64()))
        last = ranked.group_by(keys).aggregate([("__at", "max")])["__at_max"]
        return table.take(order.take(last.combine_chunks()))

    def run(batches):
        pending, size = [], 0
        for batch in batches:
            pending.append(batch)
            size += batch.nbytes
            if size > PENDING:
                table = reduced(pa.Table.from_batches(pending))
                pending, size = table.to_batches(), table.nbytes
                if size > PENDING // 2:
                    yield from pending
                    pending, size = [], 0
        if pending:
            yield from reduced(pa.Table.from_batches(pending)).to_batches()

    return run


class ChangeTarget:
    """``folder`` must be durable and reached by all executors. ``partitions`` of the state are fixed when a checkpoint is
    new (the session's shuffle partitions if not given), and so are its pages: PAGE_KEYS of the rows then known to a page, or
    of ``expected_keys`` if the table will grow to more. A visit reads a page, and writes what changed."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], keep_deletes: timedelta = KEEP_DELETES,
                 partitions: int | None = None, expected_keys: int = 0):
        self.spark, self.folder, self.keys, self.keep, self.partitions = spark, folder.rstrip("/"), keys, keep_deletes, partitions
        self.expected_keys = expected_keys

    def create(self, rows: DataFrame, ts: str = "timestamp", txn: str = "bigint") -> "ChangeTarget":
        """Start from ``rows`` (one per key); any change is newer than they are. ``ts`` and ``txn``: the log's types."""
        first = rows.select(F.lit("insert").alias("op"), F.lit(None).cast(ts).alias("ts"), F.lit(None).cast(txn).alias("txn"),
                            F.struct(*[field(c) for c in rows.columns]).alias("after"), *[field(k).alias(f"key_{i}") for i, k in enumerate(self.keys)])
        path = f"{self.folder}/start-0"
        first.write.parquet(path)
        self._register(0, None, path)
        return self

    def _register(self, generation: int, checkpoint: str | None, start: str) -> None:
        row = self.spark.createDataFrame([(generation, checkpoint, start)], "generation int, checkpoint string, start string")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/generations")

    def _generation(self) -> Row:
        return self.spark.read.parquet(f"{self.folder}/generations").orderBy(F.desc("generation")).first()

    def _committed(self, checkpoint: str) -> bool:
        try:
            return not self.spark.read.text(f"{checkpoint}/commits").isEmpty()
        except AnalysisException:  # no such folder yet
            return False

    def state(self) -> DataFrame:
        """The last change of every key that is not forgotten: op, ts, txn, after and the keys as key_0, key_1, ..."""
        now = self._generation()
        if now["checkpoint"] is None or not self._committed(now["checkpoint"]):
            return self.spark.read.parquet(now["start"])
        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        kinds = self.spark.read.parquet(now["start"]).schema
        names = [f"key_{i}" for i in range(len(self.keys))]

        held = self.spark.read.format("statestore").option("path", now["checkpoint"]).option("stateVarName", "held").load()
        columns = ["id", *names, "ts", "txn", "after", "until"]
        rows = held.select("key.page", "list_element.*").select("page", "number", F.explode(F.arrays_zip(*columns)).alias("row"))
        last = rows.groupBy("page", "row.id").agg(F.max_by("row", "number").alias("last"))
        return last.select(F.expr("IF(last.until IS NULL, 'insert', 'delete')").alias("op"),
                           *[_back(F.col(f"last.{c}"), kinds[c].dataType).alias(c) for c in ("ts", "txn")],
                           F.from_json("last.after", kinds["after"].dataType, _JSON).alias("after"),
                           *[_back(F.col(f"last.{n}"), kinds[n].dataType).alias(n) for n in names])

    def rows(self) -> DataFrame:
        """The table as it stands after the last finished batch: no deleted keys, only its own columns."""
        return self.state().filter("op <> 'delete'").select("after.*")

    def subscribe(self, log: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Apply a stream of changes (op, ts, txn, the keys, after) until it ends or is stopped."""
        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        now = self._generation()
        if now["checkpoint"] != checkpoint:
            start = f"{self.folder}/start-{now['generation'] + 1}-{new_folder(self.spark, 's').rpartition('-')[2]}"
            self.state().write.parquet(start)
            self._register(now["generation"] + 1, checkpoint, start)
        else:
            start = now["start"]
        first = self.spark.read.parquet(start)
        pages = max(-(-max(first.count(), self.expected_keys) // PAGE_KEYS), LEAST_PAGES)
        names = [f"key_{i}" for i in range(len(self.keys))]
        kinds = first.schema

        def plain(rows: DataFrame) -> DataFrame:
            keys = [_plain(F.col(n), kinds[n].dataType).alias(n) for n in names]
            # a key's text; adding zero makes -0.0 and 0.0 one key, as they are in a grouping
            same = [(k + F.lit(0.0).cast(kinds[n].dataType)).alias(n) if isinstance(kinds[n].dataType, (T.DoubleType, T.FloatType)) else k for k, n in zip(keys, names)]
            return rows.select("op", *[_plain(F.col(c), kinds[c].dataType).alias(c) for c in ("ts", "txn")],
                               F.to_json("after", _JSON).alias("after"), *keys, F.to_json(F.struct(*same), _JSON).alias("id")) \
                .withColumn("page", F.pmod(F.xxhash64("id"), F.lit(pages)))

        changes = plain(log.select("op", *[F.col(c).cast(kinds[c].dataType).alias(c) for c in ("ts", "txn", "after")],
                                   *[field(k).cast(kinds[n].dataType).alias(n) for k, n in zip(self.keys, names)]))
        kind, partitions = changes.schema, int(self.partitions or self.spark.conf.get("spark.sql.shuffle.partitions"))
        # the newest of each key, first where the changes are read and then where a page's come together
        changes = changes.mapInArrow(_newest(["id"]), kind).repartition(partitions, "page").mapInArrow(_newest(["id"]), kind)
        fields = [kind["id"], *[kind[n] for n in names], kind["ts"], kind["txn"], kind["after"], T.StructField("until", T.LongType())]
        segment = T.StructType([T.StructField("number", T.LongType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]])
        handled = F.unix_millis(F.current_timestamp()).alias("handled")
        timed = changes.select("*", handled, F.current_timestamp().alias("now")).withWatermark("now", "0 seconds")
        known = plain(first).select("*", handled)
        known = known.groupBy("page").agg(F.collect_list(F.struct(*[c for c in known.columns if c != "page"])).alias("rows"))
        applied = timed.groupBy("page").transformWithState(
            _LastChanges(segment, self.keep), T.StructType([kind["page"]]), "Update", "EventTime", known.groupBy("page"))
        writer = applied.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        shuffle, usual = "spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions")
        try:  # a query keeps the settings it started with
            self.spark.conf.set(shuffle, str(partitions))
            return (writer.trigger(availableNow=True) if available_now else writer).start()
        finally:
            self.spark.conf.set(shuffle, usual)
