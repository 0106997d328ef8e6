"""Sources, sinks, jobs and streams. Files are derived from the given tables into the shared folder."""

from __future__ import annotations

from dataclasses import replace

import uuid

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.aggregates import Agg
from millrace.operators.rules import Rule
from millrace.plans.job import Job, Step, compile_job, run_job
from millrace.streaming.targets import ChangeTarget
from millrace.session import new_folder
from millrace.sources import readers, sinks
from millrace.streaming import operators as streams
from workload.registry import query, table
from workload.rules import ORDER_RULES, RULES_SQL

# -- sources ----------------------------------------------------------------------------------------------------

@query("extract_query", """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000
    AND o_orderpriority = '1-URGENT' GROUP BY o_orderstatus""")
def extract_query(spark, sf_dir):
    name = f"orders_{uuid.uuid4().hex}"
    return readers.query(
        spark, f"SELECT o_orderstatus, count(*) AS n FROM {name} WHERE o_totalprice > :price AND o_orderpriority = :level "
               "GROUP BY o_orderstatus",
        {"price": 250000, "level": "1-URGENT"}, {name: table(spark, sf_dir, "orders")})


@query("extract_stream", "SELECT event_id, event_type, value FROM events")
def extract_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("event_id", "event_type", "value")
    return drained(spark, stream, "extract-stream")


def _scan(key: str, fmt: str, sql: str):
    """Write the customer table in a format, then read it back through the scan."""

    @query(key, sql)
    def run(spark, sf_dir):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        path = new_folder(spark, key)
        if fmt == "csv":
            customers.write.option("header", True).csv(path)
            return readers.csv(spark, path, customers.schema)
        if fmt == "json":
            customers.write.json(path)
            return readers.json(spark, path, customers.schema, multi_line=False)
        customers.write.option("rowTag", "customer").xml(path)
        return readers.xml(spark, path, "customer", customers.schema)

    return run


_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"
_scan("scan_csv", "csv", _CUSTOMERS)
_scan("scan_json", "json", _CUSTOMERS)
_scan("scan_xml", "xml", _CUSTOMERS)


def _as_array(batches):
    """The lines of one array a partition: an object each, between brackets."""
    mark = "["
    for batch in batches:
        lines = batch["line"].tolist()
        for i in range(len(lines)):
            lines[i], mark = mark + lines[i], ","
        yield pd.DataFrame({"line": lines})
    yield pd.DataFrame({"line": ["[]" if mark == "[" else "]"]})


@query("scan_json_array", """SELECT o_orderkey, o_custkey, 'a "}" in ' || o_orderpriority AS note FROM orders""")
def scan_json_array(spark, sf_dir):
    """Orders written as large arrays, each read back by many tasks."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "concat('a \"}\" in ', o_orderpriority) AS note")
    path = new_folder(spark, "scan-json-array")
    orders.select(F.to_json(F.struct("*")).alias("line")).mapInPandas(_as_array, "line string").write.text(path)
    return readers.json(spark, path, orders.schema, split=True)


def event_stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = readers.stream_files(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, stream, label: str):
    """Run a stream over what is there now and read back what it wrote."""
    path = new_folder(spark, label)
    sinks.load_stream(stream, path, new_folder(spark, f"{label}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("scan_kafka", "SELECT CAST(event_id AS VARCHAR) AS key, 'shop' AS origin, event_id, user_id, event_type FROM events")
def scan_kafka(spark, sf_dir):
    # no broker here: the parse stage reads a file stream of records shaped like Kafka's
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = new_folder(spark, "kafka-records")
    records = sinks.kafka_records(events, "event_id", {"origin": "shop"}).withColumn("value", F.col("value").cast("binary"))
    sinks.write_files(records, path)
    parsed = readers.parse_kafka(readers.stream_files(spark, path, records.schema), events.schema)
    return drained(spark, parsed.select("key", F.col("headers")["origin"].alias("origin"), *events.columns), "scan-kafka")


# -- sinks ------------------------------------------------------------------------------------------------------

@query("sink_kafka", """SELECT CAST(event_id AS VARCHAR) AS key,
    '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def sink_kafka(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sinks.kafka_records(events, "event_id")


def _table_name(key: str) -> str:
    return f"millrace_{key}_{uuid.uuid4().hex}"


@query("load_append", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_suppkey % 2 = 0")
def load_append(spark, sf_dir):
    suppliers, name = table(spark, sf_dir, "supplier"), _table_name("append")
    sinks.load_table(suppliers, name, create=True, path=new_folder(spark, "append"))
    sinks.load_table(suppliers.filter("s_suppkey % 2 = 0"), name)
    return spark.table(name)


@query("load_truncate", "SELECT * FROM supplier WHERE s_suppkey % 2 = 0")
def load_truncate(spark, sf_dir):
    suppliers, name = table(spark, sf_dir, "supplier"), _table_name("truncate")
    sinks.load_table(suppliers, name, create=True, path=new_folder(spark, "truncate"))
    sinks.load_table(suppliers.filter("s_suppkey % 2 = 0"), name, truncate=True)
    return spark.table(name)


@query("load_create", "SELECT p_partkey, p_name, p_size, p_retailprice, p_size > 25 AS big FROM part")
def load_create(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_size", "p_retailprice", "p_size > 25 AS big")
    name = _table_name("create")
    sinks.load_table(parts, name, create=True, path=new_folder(spark, "create"))
    return spark.table(name)


@query("load_stream", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def load_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    return drained(spark, stream, "load-stream")


@query("sink_file", """SELECT p_partkey, p_brand, (SELECT count(*) FROM part) AS recorded FROM part""")
def sink_file(spark, sf_dir):
    path = new_folder(spark, "sink-file")
    sinks.write_files(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), path, "json", "overwrite", metadata=True)
    sidecar = spark.read.json(f"{path}.metadata").select(F.col("rows").alias("recorded"))  # one row
    return spark.read.schema("p_partkey bigint, p_brand string").json(path).crossJoin(F.broadcast(sidecar))


# -- jobs -------------------------------------------------------------------------------------------------------

def _job(sf_dir: str, destination: dict | None = None) -> Job:
    return Job.from_dict({
        "name": "order bands",
        "source": {"format": "parquet", "path": f"{sf_dir}/orders.parquet"},
        "steps": [
            {"type": "filter", "config": {"conditions": [
                {"field": "o_totalprice", "operator": "greaterThan", "value": "100000"}]}},
            {"type": "rules", "config": {"rules": [
                {"source": "o_orderstatus", "target": "status", "type": "Lowercase", "order": 1},
                {"source": "o_orderdate", "target": "month", "type": "DateFormat", "format": "yyyy-MM", "order": 2},
                {"source": "o_totalprice", "target": "price", "type": "Round", "order": 3},
                {"source": "o_totalprice", "target": "band", "type": "Conditional", "order": 4, "params": {
                    "condition": "> 250000", "trueValue": "large", "falseValue": "small"}}]}},
            {"type": "summarize", "config": {"group_by": ["band", "month", "status"], "measures": [
                {"field": "price", "function": "sum", "output": "total"},
                {"field": "price", "function": "count", "output": "orders"}]}}],
        "destination": destination})


_JOB_SQL = """SELECT band, month, status, sum(price) AS total, count(*) AS orders FROM
    (SELECT CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS band, strftime(o_orderdate, '%Y-%m') AS month,
      lower(o_orderstatus) AS status, round_even(o_totalprice, 0) AS price FROM orders WHERE o_totalprice > 100000)
    GROUP BY band, month, status"""


@query("job_run", _JOB_SQL)
def job_run(spark, sf_dir):
    return compile_job(spark, _job(sf_dir))


@query("job_record", f"SELECT 'order bands' AS job, 'Completed' AS status, count(*) AS processed FROM ({_JOB_SQL})")
def job_record(spark, sf_dir):
    record = run_job(spark, _job(sf_dir, {"path": new_folder(spark, "job"), "format": "parquet"}))
    return record.select("job", "status", "processed")


@query("job_record_failed", """SELECT 'order bands' AS job, 'Failed' AS status, CAST(0 AS BIGINT) AS processed, true AS told,
    count(*) > 0 AS had_rows FROM orders""")
def job_record_failed(spark, sf_dir):
    """A job whose rows cannot be converted leaves a record of its failure."""
    job = replace(_job(sf_dir, {"path": new_folder(spark, "job"), "format": "parquet"}), steps=[
        Step("aggregate", {"outputs": {"x": {"function": "Custom", "expression": "sum(CAST(o_orderstatus AS INT))"}}})])
    record = run_job(spark, job, keep_going=True)
    rows = table(spark, sf_dir, "orders").agg((F.count(F.lit(1)) > 0).alias("had_rows"))
    return record.crossJoin(F.broadcast(rows)).select(  # one row each
        "job", "status", "processed", F.col("message").contains("CAST_INVALID_INPUT").alias("told"), "had_rows")


# -- streams ----------------------------------------------------------------------------------------------------

def order_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    return readers.stream_files(spark, sf_dir, schema, pathGlobFilter="orders.parquet")


@query("rules_apply_stream", RULES_SQL)
def rules_apply_stream(spark, sf_dir):
    return drained(spark, streams.transform(order_stream(spark, sf_dir), ORDER_RULES), "rules-stream")


@query("stream_transform", """SELECT event_id, upper(event_type) AS kind, round_even(value, 0) AS amount FROM events""")
def stream_transform(spark, sf_dir):
    rules = [Rule("event_type", "kind", "Uppercase", order=1), Rule("value", "amount", "Round", order=2)]
    out = streams.transform(event_stream(spark, sf_dir), rules).select("event_id", "kind", "amount")
    return drained(spark, out, "stream-transform")


@query("stream_window_agg", """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, event_type, n, total, low, high, mean,
      first_id, last_id FROM
    (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
      min(value) AS low, max(value) AS high, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 9) AS mean,
      arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1, 2)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_window_agg(spark, sf_dir):
    stream = event_stream(spark, sf_dir).withColumn("amount", F.col("value").cast("decimal(18,2)"))
    out = streams.window_aggregate(stream, "ts", "1 hour", "event_type", {
        "n": Agg("Count"), "total": Agg("Sum", "amount"), "low": Agg("Min", "value"), "high": Agg("Max", "value"),
        "mean": Agg("Custom", expression="avg(CAST(amount AS DECIMAL(20,10)))"), "first_id": Agg("First", "event_id"),
        "last_id": Agg("Last", "event_id")}, "10 minutes")
    found = drained(spark, out, "stream-window")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n",
        F.col("total").cast("double").alias("total"), "low", "high",
        F.round(F.col("mean").cast("double"), 9).alias("mean"), "first_id", "last_id")


@query("stream_join", """SELECT c.event_id, p.event_id AS right_event_id, c.user_id FROM events c JOIN events p
    ON c.user_id = p.user_id AND abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 7200000000
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_join(spark, sf_dir):
    columns = ["event_id", "user_id", "ts"]
    clicks = event_stream(spark, sf_dir).filter("event_type = 'click'").select(*columns)
    purchases = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select(*columns)
    joined = streams.join_streams(clicks, purchases, "user_id", "user_id", "ts", "ts", "2 HOURS", "10 minutes")
    return drained(spark, joined.select("event_id", "right_event_id", "user_id"), "stream-join")


@query("stream_process_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_process_batch(spark, sf_dir):
    path = new_folder(spark, "stream-batches")

    def handle(batch, batch_id):
        # one folder per batch, replaced when the batch is handed over again
        sinks.write_files(batch.groupBy("event_type").count(), f"{path}/batch={batch_id}", mode="overwrite")

    streams.process_batches(event_stream(spark, sf_dir), handle, new_folder(spark, "batches-checkpoint")).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("count").alias("n"))


@query("cdc_stream", """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM events)
    SELECT user_id, event_type, value FROM last WHERE n = 1 AND event_type <> 'error'
    UNION ALL SELECT c_custkey, 'none', 0.0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def cdc_stream(spark, sf_dir):
    """Four micro-batches in no order of time: the events lie in files by the hash of their id, one of a batch for every
    core. The state has a partition for every core, four at least."""
    cores = spark.sparkContext.defaultParallelism
    target = ChangeTarget(spark, new_folder(spark, "cdc-target"), ["user_id"], partitions=max(4, cores)).create(
        table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "'none' AS event_type", "0.0D AS value"))
    source = new_folder(spark, "cdc-source")
    events = table(spark, sf_dir, "events")
    events.repartition(4 * cores, "event_id").write.parquet(source)
    stream = readers.stream_files(spark, source, events.schema, maxFilesPerTrigger=cores)
    log = stream.withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.expr("IF(event_type = 'error', 'delete', 'update')").alias("op"), "ts", F.col("event_id").alias("txn"), "user_id",
        F.expr("IF(event_type = 'error', NULL, named_struct('user_id', user_id, 'event_type', event_type, 'value', value))")
        .alias("after"))
    streams.subscribe_changes(log, target, new_folder(spark, "cdc-checkpoint")).awaitTermination()
    return target.rows()
