"""Sources, sinks, jobs and streams."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from millrace.operators import quality_rules
from millrace.operators.aggregates import Agg
from millrace.operators.quality_rules import QualityRule
from millrace.operators.rules import Rule, apply_rules
from millrace.plans.job import Job, compile_job, run_job
from millrace.streaming import targets
from millrace.streaming.targets import ChangeTarget
from millrace.session import new_folder
from millrace.sources import readers, sinks
from millrace.streaming import operators as streams
from tests.conftest import rows


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_query_binds_parameters(spark):
    df = spark.range(5)
    assert rows(readers.query(spark, "SELECT id FROM numbers WHERE id > :low", {"low": 2}, {"numbers": df})) == [(3,), (4,)]


def test_json_array_document(spark, folder):
    path = os.path.join(folder, "a.json")
    with open(path, "w") as out:
        out.write('[{"a": 1, "b": "x"}, {"a": null}, {"b": "y"}]')
    assert rows(readers.json(spark, path, T.StructType.fromDDL("a int, b string"))) == [(None, None), (None, "y"), (1, "x")]


@pytest.mark.parametrize("text", ["[]", "null", ""])
def test_empty_json_documents(spark, folder, text):
    path = os.path.join(folder, "a.json")
    with open(path, "w") as out:
        out.write(text)
    assert readers.json(spark, path, T.StructType.fromDDL("a int")).filter("a IS NOT NULL").isEmpty()


def test_json_lines_that_are_no_objects_are_dropped(spark, folder):
    path = os.path.join(folder, "a.json")
    with open(path, "w") as out:
        out.write('{"a": 1}\n5\n"text"\n{"a": 2}\n{broken\n')
    schema = T.StructType.fromDDL("a int")
    assert rows(readers.json(spark, path, schema, multi_line=False)) == [(1,), (2,)]
    assert readers.json(spark, path, schema, multi_line=False, keep_corrupt=True).count() == 5


def test_csv_drops_rows_that_do_not_fit(spark, folder):
    path = os.path.join(folder, "a.csv")
    with open(path, "w") as out:
        out.write("a,b\n1,x\nz,y\n3,\n")
    schema = T.StructType.fromDDL("a int, b string")
    assert rows(readers.csv(spark, path, schema)) == [(1, "x"), (3, None)]


def test_jdbc_options():
    plain = readers.jdbc_options("PostgreSql", "jdbc:x", sql="SELECT 1")
    assert plain["query"] == "SELECT 1" and plain["queryTimeout"] == "300"
    split = readers.jdbc_options("MySql", "jdbc:x", sql="SELECT * FROM t", partition_column="id", lower=0, upper=10, partitions=4)
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "4" and "query" not in split
    for bad in ({"kind": "Oracle", "url": "u", "table": "t"}, {"kind": "MySql", "url": "u"},
                {"kind": "MySql", "url": "u", "table": "t", "partition_column": "id"}):
        with pytest.raises((NotImplementedError, ValueError)):
            readers.jdbc_options(**bad)


def test_database_types():
    schema = T.StructType.fromDDL("a int, b string, c decimal(30,2), d timestamp, e array<int>")
    assert sinks.create_statement("PostgreSql", "t", schema) == (
        'CREATE TABLE t ("a" INTEGER, "b" TEXT, "c" NUMERIC(18, 6), "d" TIMESTAMP, "e" TEXT)')
    assert sinks.jdbc_column_types("SqlServer", schema)["d"] == "DATETIME2"


def test_load_table(spark, folder):
    name = "loads_" + os.path.basename(folder).replace("-", "_")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    with pytest.raises(ValueError):
        sinks.load_table(df, name)
    assert sinks.load_table(df, name, create=True, path=folder + "/t") == 2
    assert sinks.load_table(df.select("b", "a"), name) == 2
    assert sinks.load_table(df.select("a"), name) == 2
    assert rows(spark.table(name)) == [(1, None), (1, "x"), (1, "x"), (2, None), (2, "y"), (2, "y")]
    with pytest.raises(ValueError):
        sinks.load_table(df.withColumn("c", F.lit(1)), name)
    assert sinks.load_table(df.limit(1), name, truncate=True) == 1
    assert spark.table(name).count() == 1
    assert sinks.load_table(df.limit(0), name) == 0


def test_swap_table_may_read_itself(spark):
    name = "swap_self"
    sinks.swap_table(spark.range(3), name)
    sinks.swap_table(spark.table(name).withColumn("id", F.col("id") * 10), name)
    assert rows(spark.table(name)) == [(0,), (10,), (20,)]


def test_file_sink_counts_and_sidecar(spark, folder):
    path = folder + "/out"
    assert sinks.write_files(spark.range(7), path, "json", metadata=True) == 7
    assert sinks.write_files(spark.range(2), path, "json", "overwrite", metadata=True) == 2
    assert spark.read.json(path).count() == 2
    assert [r["rows"] for r in spark.read.json(path + ".metadata").collect()] == [2]
    assert sinks.write_files(spark.range(0), folder + "/empty") == 0


def test_kafka_records_round_trip(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    records = sinks.kafka_records(df, "a", {"h": "é"}).withColumn("value", F.col("value").cast("binary"))
    nothing = records.limit(1).withColumn("value", F.lit(None).cast("binary")).withColumn("key", F.lit("k"))
    parsed = readers.parse_kafka(records.unionByName(nothing), df.schema)
    assert rows(parsed.select("key", F.col("headers")["h"], "a", "b")) == [("1", "é", 1, "x"), ("2", "é", 2, None)]
    assert sinks.kafka_records(df).select(F.length("key")).first()[0] == 36
    assert readers.kafka_options("s", ["a", "b"])["subscribe"] == "a,b"


def test_job(spark, folder):
    spark.createDataFrame([(1, "a", 5.0), (2, "b", 50.0), (3, "a", 70.0)], "id int, g string, v double").write.parquet(folder + "/in")
    job = Job.from_json(json.dumps({
        "name": "j", "source": {"path": folder + "/in"},
        "steps": [{"type": "Filter", "config": {"conditions": [{"field": "v", "operator": "greaterThan", "value": "10"}]}},
                  {"type": "rules", "config": {"rules": [{"source": "g", "target": "g", "type": "Uppercase"}]}},
                  {"type": "join", "config": {"table": "names", "on": [{"left": "g", "right": "code"}]}},
                  {"type": "aggregate", "config": {"group_by": ["label"], "outputs": {"n": {"function": "Count"}}}}],
        "destination": {"path": folder + "/out"}}))
    names = spark.createDataFrame([("A", "first"), ("B", "second")], "code string, label string")
    record = run_job(spark, job, {"names": names}).first()
    assert (record["status"], record["processed"]) == ("Completed", 2)
    assert rows(spark.read.parquet(folder + "/out")) == [("first", 1), ("second", 1)]
    with pytest.raises(ValueError):
        compile_job(spark, Job("x", {"path": folder + "/in"}, [type(job.steps[0])("nope", {})]))


def test_quarantine_in_one_write(spark, folder):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    quality_rules.write_quarantine(df, [QualityRule("v", "NotNull", "v")], folder + "/q")
    assert rows(spark.read.parquet(folder + "/q"), "id", "severity", "quarantined") == [
        (1, None, "false"), (2, "Error", "true")]


# -- streams ----------------------------------------------------------------------------------------------------

EVENTS = "id int, k string, ts timestamp, v double"


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute)


def feed(spark, folder, batches):
    """One file per batch, read in order, one per trigger."""
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in{number}")
    base = spark.read.parquet(f"{folder}/in0").schema
    os.makedirs(folder + "/src", exist_ok=True)
    for number in range(len(batches)):
        part = next(f for f in os.listdir(f"{folder}/in{number}") if f.endswith(".parquet"))
        os.link(f"{folder}/in{number}/{part}", f"{folder}/src/{number}.parquet")
        os.utime(f"{folder}/src/{number}.parquet", (1_700_000_000 + number * 10,) * 2)
    return readers.stream_files(spark, folder + "/src", base, files_per_trigger=1)


def drain(spark, stream, folder):
    sinks.load_stream(stream, folder + "/out", folder + "/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/out")


def test_stream_rules_equal_batch_rules(spark, folder):
    batches = [[(1, " a ", at(0), 2.5)], [(2, None, at(1), 3.5)]]
    rules = [Rule("k", "k", "Trim"), Rule("v", "r", "Round")]
    out = drain(spark, streams.transform(feed(spark, folder, batches), rules), folder)
    assert rows(out) == rows(apply_rules(spark.createDataFrame(batches[0] + batches[1], EVENTS), rules))


def test_windows_close_and_late_rows_are_dropped(spark, folder):
    # the third batch emits the first window, the fourth brings a row that is too late for it
    batches = [[(1, "a", at(1), 1.0), (2, "a", at(4), 2.0), (3, "b", at(4.5), 3.0)], [(4, "a", at(30), 4.0)],
               [(6, "a", at(31), 5.0)], [(5, "a", at(2), 99.0)]]
    stream = feed(spark, folder, batches)
    out = drain(spark, streams.window_aggregate(stream, "ts", "5 minutes", "k", {
        "n": Agg("Count"), "total": Agg("Sum", "v"), "first": Agg("First", "id"), "last": Agg("Last", "id"),
        "mean": Agg("Average", "v")}, "10 minutes"), folder)
    assert rows(out, "window_start", "k", "n", "total", "first", "last", "mean") == [
        (at(0), "a", 2, 3.0, 1, 2, 1.5), (at(0), "b", 1, 3.0, 3, 3, 3.0)]


@pytest.mark.parametrize("tiles", [1, 3])
def test_stream_join_bounds(spark, folder, tiles):
    batches = [[(1, "a", at(0), 1.0), (2, "b", at(0), 1.0)], [(3, "a", at(5), 1.0), (4, "a", at(11), 1.0), (5, "b", at(10), 1.0)]]
    stream = feed(spark, folder, batches)
    left, right = stream.filter("id < 3"), stream.filter("id >= 3")
    joined = streams.join_streams(left, right, "k", "k", "ts", "ts", "10 MINUTES", "1 hour", tiles)
    assert rows(drain(spark, joined.select("id", "right_id"), folder)) == [(1, 3), (2, 5)]


LOG = "op string, ts timestamp, txn bigint, k string, after struct<k:string,v:double,at:timestamp,tags:map<string,date>>"


def log_stream(spark, path, changes):
    """A stream of change files, one per batch: (op, minute, txn, key, value)."""
    for i, batch in enumerate(changes):
        rows_ = [(op, at(minute), txn, k, None if op == "delete" else (k, v, at(minute), {"d": dt.date(2024, 1, 1 + minute % 9)}))
                 for op, minute, txn, k, v in batch]
        spark.createDataFrame(rows_, LOG).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def change_target(spark, keep=None, keys=("a", "c", "d")):
    start = [(k, 0.5, at(0), {"d": dt.date(2020, 2, 29)}) for k in keys]
    target = ChangeTarget(spark, new_folder(spark, "target"), ["k"], **({"keep_deletes": keep} if keep else {}))
    return target.create(spark.createDataFrame(start, "k string, v double, at timestamp, tags map<string,date>"))


BATCHES = [[("update", 3, 1, "a", 1.0), ("update", 0, 2, "b", 2.0)], [("delete", 4, 3, "a", None), ("update", 6, 4, "b", 3.0)],
           [("update", 2, 5, "a", 9.0), ("update", 5, 6, "b", 9.0), ("insert", 1, 7, "e", 5.0), ("update", 2, 8, None, 4.0)]]
EXPECTED = [(None, 4.0), ("b", 3.0), ("c", 0.5), ("d", 0.5), ("e", 5.0)]


def test_change_subscription_over_several_batches(spark, folder):
    """Late changes, and an update older than its key's deletion, change nothing; values of all types come back."""
    target = change_target(spark)
    assert rows(target.rows(), "k", "v") == [("a", 0.5), ("c", 0.5), ("d", 0.5)]
    stream = log_stream(spark, f"{folder}/log", BATCHES)
    streams.subscribe_changes(stream, target, f"{folder}/checkpoint").awaitTermination()
    assert rows(target.rows(), "k", "v") == EXPECTED
    held = {r.k: (r.at, r.tags) for r in target.rows().collect()}
    assert held["b"] == (at(6), {"d": dt.date(2024, 1, 7)}) and held["c"] == (at(0), {"d": dt.date(2020, 2, 29)})
    # the same checkpoint goes on where it stopped
    log_stream(spark, f"{folder}/log", [[]] * 3 + [[("update", 9, 9, "c", 8.0)] * 3])
    streams.subscribe_changes(stream, target, f"{folder}/checkpoint").awaitTermination()
    assert rows(target.rows(), "k", "v") == [*EXPECTED[:2], ("c", 8.0), *EXPECTED[3:]]


def test_changes_after_a_restart_on_a_new_checkpoint(spark, folder):
    """What was applied is kept, tombstones too; later changes win, and a source that is sent again changes nothing."""
    target = change_target(spark)
    streams.subscribe_changes(log_stream(spark, f"{folder}/one", BATCHES), target, f"{folder}/c1").awaitTermination()
    late = [[("update", 3, 1, "a", 7.0), ("update", 7, 1, "b", 7.0)], [("update", 4, 4, "a", 6.0), ("delete", 8, 1, "d", None)]]
    streams.subscribe_changes(log_stream(spark, f"{folder}/two", late), target, f"{folder}/c2").awaitTermination()
    after = [(None, 4.0), ("a", 6.0), ("b", 7.0), ("c", 0.5), ("e", 5.0)]
    assert rows(target.rows(), "k", "v") == after
    streams.subscribe_changes(log_stream(spark, f"{folder}/one", []), target, f"{folder}/c3").awaitTermination()
    assert rows(target.rows(), "k", "v") == after


def test_tombstones_expire(spark, folder):
    target = change_target(spark, dt.timedelta(milliseconds=1))
    streams.subscribe_changes(log_stream(spark, f"{folder}/log", BATCHES[:2]), target, f"{folder}/c").awaitTermination()
    again = log_stream(spark, f"{folder}/log", [[]] * 3 + [[("update", 1, 1, "a", 2.5), ("update", 1, 1, "c", 2.5)]])
    streams.subscribe_changes(again, target, f"{folder}/c").awaitTermination()
    assert rows(target.rows(), "k", "v") == [("a", 2.5), ("b", 3.0), ("c", 2.5), ("d", 0.5)]


def test_one_key_with_most_changes(spark, folder):
    """Of a key's changes only the newest of each part of a file goes to its state."""
    from millrace.streaming.targets import _newest

    many = [("update", i % 60, i, "a", float(i)) for i in range(3000)] + [("update", 1, 1, "b", 1.0)]
    target = change_target(spark)
    streams.subscribe_changes(log_stream(spark, f"{folder}/log", [many]), target, f"{folder}/c").awaitTermination()
    assert rows(target.rows().filter("k < 'c'"), "k", "v") == [("a", 2999.0), ("b", 1.0)]
    plain = spark.read.parquet(f"{folder}/log/000").select("ts", "txn", "k")
    assert plain.mapInArrow(_newest(["k"]), plain.schema).count() == 2


def test_keys_share_pages_of_state(spark, folder, monkeypatch):
    """Visits to the state go by page, not by key; a page keeps every key's last change and is written anew now and then."""
    monkeypatch.setattr(targets, "LEAST_PAGES", 2)
    keys = [f"k{i:03}" for i in range(200)]
    target = change_target(spark, keys=keys)
    changes = [[("update" if (i + batch) % 7 else "delete", batch + 1, i, k, float(batch)) for i, k in enumerate(keys) if batch != 1 or i < 3]
               for batch in range(6)]
    # one that comes late
    changes.append([("update", 2, 5, "k005", -1.0)])
    query = streams.subscribe_changes(log_stream(spark, f"{folder}/log", changes), target, f"{folder}/c")
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 2
    assert rows(target.rows(), "k", "v") == [(k, 5.0) for i, k in enumerate(keys) if (i + 5) % 7]
    held = spark.read.format("statestore").option("path", f"{folder}/c").option("stateVarName", "held").load()
    assert 200 <= held.selectExpr("sum(size(list_element.id))").first()[0] <= 2 * 200 + 2 * targets.SPARE


class FakeConnection:
    def __init__(self, exists):
        self.exists, self.statements, self.asked = exists, [], None

    def getMetaData(self):
        return self

    def getTables(self, catalog, schema, name, types):
        self.asked = (schema, name)
        return self

    def next(self):
        return self.exists

    def createStatement(self):
        return self

    def executeUpdate(self, text):
        self.statements.append(text)


def test_a_missing_database_table_is_created_only_if_asked():
    schema = T.StructType.fromDDL("a int, b string")
    with pytest.raises(ValueError):
        sinks.ensure_jdbc_table(FakeConnection(False), "MySql", "t", schema, create=False)
    there, missing = FakeConnection(True), FakeConnection(False)
    sinks.ensure_jdbc_table(there, "MySql", "t", schema, create=True)
    sinks.ensure_jdbc_table(missing, "PostgreSql", "s.t", schema, create=True)
    assert there.statements == [] and missing.asked == ("s", "t")
    assert missing.statements == ['CREATE TABLE s.t ("a" INTEGER, "b" TEXT)']
    options = sinks.jdbc_write_options("jdbc:x", "t", {"user": "u"})
    assert options == {"url": "jdbc:x", "dbtable": "t", "batchsize": "1000", "truncate": "true", "user": "u"}


def test_a_failed_run_is_recorded(spark, folder):
    spark.createDataFrame([("x",)], "v string").write.parquet(folder + "/in")
    job = Job.from_dict({"name": "j", "source": {"path": folder + "/in"}, "destination": {"path": folder + "/out"},
                         "steps": [{"type": "aggregate", "config": {"outputs": {"n": {"function": "Custom", "expression": "sum(CAST(v AS INT))"}}}}]})
    record = run_job(spark, job, records=folder + "/runs", keep_going=True).first()
    assert (record["status"], record["processed"]) == ("Failed", 0) and "CAST_INVALID_INPUT" in record["message"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run_job(spark, job, records=folder + "/runs")
    assert spark.read.parquet(folder + "/runs").filter("status = 'Failed'").count() == 2


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from millrace import session

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=conf))
    context.master = "local[2]"
    assert os.path.isdir(session.shared_folder(SimpleNamespace(sparkContext=context, conf=conf)))
    conf.get = lambda key, default=None: "/shared" if key == "spark.checkpoint.dir" else default
    context.master = "yarn"
    assert session.shared_folder(SimpleNamespace(sparkContext=context, conf=conf)) == "/shared"
