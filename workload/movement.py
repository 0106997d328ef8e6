"""Consistency, replication, change capture, lineage and run history."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.operators import changes, consistency, hashtree, lineage, replication, runs
from millrace.session import new_folder
from millrace.sources import sinks
from workload.registry import query, table

ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate FROM orders)"
ORDERS_V2 = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1
      ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
      WHERE o_orderkey % 50 = 0)"""
KEY = ["o_orderkey"]


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def orders_v2(spark, sf_dir):
    """A second version of orders: keys dropped, prices changed, keys added."""
    first = orders(spark, sf_dir)
    kept = first.filter("o_orderkey % 10 <> 0").withColumn(
        "o_totalprice", F.expr("IF(o_orderkey % 7 = 0, o_totalprice + 1, o_totalprice)"))
    added = first.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000)
    return kept.unionByName(added)


def _word(i: int) -> str:
    digits = " + ".join(f"(instr('0123456789abcdef', substr(h, {8 * i + j}, 1)) - 1) * {16 ** (8 - j)}" for j in range(1, 9))
    return f"CAST(CAST(sum(CAST({digits} AS HUGEINT)) AS HUGEINT) AS VARCHAR)"


def _encoded(*texts: str) -> str:
    """Every field with its length before it, and a null as no text."""
    return " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts)


def _half(i: int) -> str:
    digits = " + ".join(f"(instr('0123456789abcdef', substr(h, {16 * i + j}, 1)) - 1) * CAST({16 ** (14 - j)} AS HUGEINT)" for j in range(1, 15))
    return f"CAST({digits} AS HUGEINT)"


# -- consistency ------------------------------------------------------------------------------------------------

_MATCH = f"FROM {ORDERS} s LEFT JOIN {ORDERS_V2} d USING (o_orderkey)"


@query("consistency_metrics", f"""SELECT count(*) FILTER (WHERE d.o_custkey IS NULL) AS missing,
    count(*) FILTER (WHERE d.o_totalprice <> s.o_totalprice) AS different, count(*) AS total {_MATCH}""")
def consistency_metrics(spark, sf_dir):
    return consistency.metrics(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY)


@query("consistency_validate", f"""SELECT count(*) FILTER (WHERE d.o_custkey IS NULL OR d.o_totalprice <> s.o_totalprice) = 0
    AS consistent {_MATCH}""")
def consistency_validate(spark, sf_dir):
    return consistency.is_consistent(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY)


@query("consistency_validate_same", f"""SELECT count(*) FILTER (WHERE d.o_custkey IS NULL OR d.o_totalprice <> s.o_totalprice) = 0
    AS consistent FROM {ORDERS} s LEFT JOIN (SELECT * FROM {ORDERS} UNION ALL SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey)
      FROM {ORDERS} WHERE o_orderkey % 50 = 0) d USING (o_orderkey)""")
def consistency_validate_same(spark, sf_dir):
    """Rows that only the destination has do not count."""
    first = orders(spark, sf_dir)
    added = first.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000)
    return consistency.is_consistent(first, first.unionByName(added), KEY)


@query("consistency_diff", f"""SELECT o_orderkey, s.o_totalprice, CASE WHEN d.o_custkey IS NULL THEN 'missing'
    ELSE 'different' END AS status {_MATCH} WHERE d.o_custkey IS NULL OR d.o_totalprice <> s.o_totalprice""")
def consistency_diff(spark, sf_dir):
    found = consistency.differences(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY)
    return found.select("o_orderkey", "o_totalprice", "status")


@query("consistency_diff_tree", f"""WITH v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 0 THEN NULL
      WHEN o_orderkey % 701 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 1000 <> 500)
    SELECT o_orderkey, s.o_totalprice, CASE WHEN v.o_custkey IS NULL THEN 'missing' ELSE 'different' END AS status
    FROM {ORDERS} s LEFT JOIN v USING (o_orderkey) WHERE v.o_totalprice IS DISTINCT FROM s.o_totalprice""")
def consistency_diff_tree(spark, sf_dir):
    """A copy of orders in which few rows are lost or changed, compared by hash trees."""
    first = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice")
    copy = first.filter("o_orderkey % 1000 <> 500").withColumn("o_totalprice", F.expr(
        "CASE WHEN o_orderkey % 1000 = 0 THEN NULL WHEN o_orderkey % 701 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    found = consistency.differences(first, copy, KEY, by_tree=True)
    return found.select("o_orderkey", "o_totalprice", "status")


@query("hash_tree", f"""SELECT 0 AS level, CAST(0 AS BIGINT) AS node, count(*) AS n, {", ".join(
        f"CAST(sum(CAST({_half(i)} AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(2))}
    FROM (SELECT md5({_encoded("CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus")}) AS h FROM orders)""")
def hash_tree(spark, sf_dir):
    """The root of the tree of orders, added up over all its levels."""
    tree = hashtree.build(orders(spark, sf_dir), KEY, ["o_orderkey", "o_custkey", "o_orderstatus"], 12)
    return tree.filter("level = 0").select("level", "node", "n", *[F.col(s).cast("string").alias(s) for s in hashtree.SUMS])


_UPSERTED = f"""SELECT * FROM {ORDERS_V2} UNION ALL SELECT * FROM {ORDERS} WHERE o_orderkey % 10 = 0"""


@query("sync_upsert", _UPSERTED)
def sync_upsert(spark, sf_dir):
    return consistency.upsert(orders_v2(spark, sf_dir), orders(spark, sf_dir), KEY)


@query("sync_upsert_count", f"""SELECT count(*) FILTER (WHERE s.o_custkey IS NULL) AS inserted,
    count(*) FILTER (WHERE d.o_totalprice <> s.o_totalprice) AS updated,
    count(*) FILTER (WHERE s.o_custkey IS NULL OR d.o_totalprice <> s.o_totalprice) AS changed
    FROM {ORDERS_V2} d LEFT JOIN {ORDERS} s USING (o_orderkey)""")
def sync_upsert_count(spark, sf_dir):
    return consistency.upsert_count(orders_v2(spark, sf_dir), orders(spark, sf_dir), KEY)


@query("table_checksum", f"""SELECT count(*) AS row_count, {" || '-' || ".join(_word(i) for i in range(4))} AS checksum
    FROM (SELECT md5({_encoded("CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "o_orderpriority")}) AS h
      FROM orders)""")
def table_checksum(spark, sf_dir):
    return consistency.checksum(table(spark, sf_dir, "orders"),
                                ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


# -- replication ------------------------------------------------------------------------------------------------

@query("replicate_full", f"SELECT * FROM {ORDERS_V2}")
def replicate_full(spark, sf_dir):
    path = new_folder(spark, "replicate-full")
    sinks.write_files(orders(spark, sf_dir), path)
    sinks.write_files(replication.full(orders_v2(spark, sf_dir)), path, mode="overwrite")
    return spark.read.parquet(path)


@query("replicate_incremental_keys", _UPSERTED)
def replicate_incremental_keys(spark, sf_dir):
    return replication.by_keys(orders_v2(spark, sf_dir), orders(spark, sf_dir), KEY)


@query("replicate_incremental", "SELECT event_id, ts, event_type FROM events")
def replicate_incremental(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    path = new_folder(spark, "replicate-incremental")
    sinks.write_files(events.filter("ts <= TIMESTAMP '2024-01-20'"), path)
    fresh = replication.new_rows(events, spark.read.parquet(path), "ts")
    sinks.write_files(fresh, path)
    return spark.read.parquet(path)


def _log(spark, sf_dir):
    return changes.diff(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY, F.expr("TIMESTAMP '2024-01-01 00:00:00'"),
                        F.lit("t1"))


@query("replicate_cdc", f"SELECT * FROM {ORDERS_V2}")
def replicate_cdc(spark, sf_dir):
    return replication.by_changes(orders(spark, sf_dir), _log(spark, sf_dir), KEY)


@query("replicate_all", """SELECT 'nation' AS "table", count(*) AS row_count FROM nation
    UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'broken', -1""")
def replicate_all(spark, sf_dir):
    sources = {name: table(spark, sf_dir, name) for name in ("nation", "customer", "supplier", "region")}
    sources["broken"] = sources["nation"]

    def load(name, rows):
        if name == "broken":
            return sinks.load_table(rows, "millrace_no_such_table")
        return sinks.write_files(rows, new_folder(spark, f"all-{name}"))

    return replication.all_tables(spark, sources, load, ["REGION"])


# -- change capture ---------------------------------------------------------------------------------------------

@query("cdc_diff", f"""SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'insert' WHEN b.o_custkey IS NULL THEN 'delete'
      ELSE 'update' END AS op, a.o_totalprice AS old_price, b.o_totalprice AS new_price
    FROM {ORDERS} a FULL JOIN {ORDERS_V2} b USING (o_orderkey)
    WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.o_totalprice <> b.o_totalprice""")
def cdc_diff(spark, sf_dir):
    return _log(spark, sf_dir).select("o_orderkey", "op", F.col("before.o_totalprice").alias("old_price"),
                                      F.col("after.o_totalprice").alias("new_price"))


def _event_log(spark, sf_dir):
    """Events as changes of the users' state: error deletes, signup inserts, the rest updates."""
    return table(spark, sf_dir, "events").select(
        F.expr("CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END").alias("op"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("txn"), "user_id",
        F.lit(None).cast("struct<user_id:bigint,event_type:string,value:double>").alias("before"),
        F.expr("IF(event_type = 'error', NULL, named_struct('user_id', user_id, 'event_type', event_type, 'value', value))")
        .alias("after"))


@query("cdc_since", """SELECT event_id AS txn, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'""")
def cdc_since(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    # marks recorded after two earlier captures of the same log
    marks = changes.sync_mark(log.filter("ts <= TIMESTAMP '2024-01-08 00:00:00'"), "users").unionByName(
        changes.sync_mark(log, "users").select("table", F.expr("TIMESTAMP '2024-01-15 12:00:00'").alias("mark")))
    return changes.since_mark(log, marks, "users").select("txn", "user_id")


@query("cdc_apply", """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM events)
    SELECT user_id, event_type, value FROM last WHERE n = 1 AND event_type <> 'error'
    UNION ALL SELECT c_custkey, 'none', 0.0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def cdc_apply(spark, sf_dir):
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "'none' AS event_type", "0.0D AS value")
    return changes.apply(users, _event_log(spark, sf_dir), ["user_id"])


@query("cdc_sync", f"""SELECT count(*) FILTER (WHERE a.o_custkey IS NULL) AS inserted,
    count(*) FILTER (WHERE a.o_totalprice <> b.o_totalprice) AS updated,
    count(*) FILTER (WHERE b.o_custkey IS NULL) AS deleted, 0::BIGINT AS errors
    FROM {ORDERS} a FULL JOIN {ORDERS_V2} b USING (o_orderkey)""")
def cdc_sync(spark, sf_dir):
    level, counts = changes.synchronize(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY, F.current_timestamp())
    return counts


@query("cdc_sync_target", f"SELECT * FROM {ORDERS_V2}")
def cdc_sync_target(spark, sf_dir):
    return changes.synchronize(orders(spark, sf_dir), orders_v2(spark, sf_dir), KEY, F.current_timestamp())[0]


@query("cdc_table_info", """SELECT 'users' AS "table", 'user_id,event_type,value' AS tracked_columns,
    count(*) AS total_changes, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_change FROM events""")
def cdc_table_info(spark, sf_dir):
    info = changes.table_info(_event_log(spark, sf_dir), "users")
    return info.withColumn("last_change", F.date_format("last_change", "yyyy-MM-dd HH:mm:ss"))


# -- lineage ----------------------------------------------------------------------------------------------------

_RULES = json.dumps([
    {"source": "text", "target": "text", "type": "Trim", "order": 1},
    {"source": "role, text", "target": "line", "type": "Concatenate", "params": {"separator": ": "}, "order": 2},
    {"source": "line", "target": "line", "type": "Copy", "order": 3}])
_EDGES = """(SELECT conv_id AS pipeline, turn AS execution, conv_id || ':' || turn AS source_table,
    conv_id || ':' || (turn + 1) AS target_table, role FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))"""


def edges(spark, sf_dir):
    """Each turn of a conversation feeds the next one; the turns carry the same rule list."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().select(
        F.col("conv_id").alias("pipeline"), F.col("turn").alias("execution"),
        F.expr("concat(conv_id, ':', turn)").alias("source_table"),
        F.expr("concat(conv_id, ':', turn + 1)").alias("target_table"), "role", F.lit(_RULES).alias("rules"))
    return lineage.from_rules(turns)


def _roots(spark, sf_dir, turn: int):
    rows = table(spark, sf_dir, "conversations").filter(F.col("turn") == turn)
    return rows.select(F.expr("concat(conv_id, ':', turn)").alias("table")).distinct()


@query("lineage_from_rules", f"""SELECT source_table, target_table, column_name AS source_column, target_column, rule
    FROM {_EDGES}, (VALUES ('text', 'text', 'Trim'), ('role', 'line', 'Concatenate'), ('text', 'line', 'Concatenate'),
      ('line', 'line', 'Copy')) AS m(column_name, target_column, rule)""")
def lineage_from_rules(spark, sf_dir):
    flat = edges(spark, sf_dir).select("source_table", "target_table", F.inline("columns"))
    return flat.select("source_table", "target_table", F.explode("depends_on").alias("source_column"), "target_column",
                       F.col("type").alias("rule"))


@query("lineage_filter", f"SELECT pipeline, execution, source_table, target_table FROM {_EDGES} WHERE target_table = '7:2'")
def lineage_filter(spark, sf_dir):
    return lineage.select_edges(edges(spark, sf_dir), target_table="7:2").drop("columns")


def _reach(step: str, root_turn: int, depth: int | None) -> str:
    return f"""(WITH RECURSIVE e AS (SELECT DISTINCT source_table AS s, target_table AS t FROM {_EDGES}),
      walk(root_table, "table", depth) AS (
        SELECT DISTINCT conv_id || ':' || turn, conv_id || ':' || turn, 0 FROM conversations WHERE turn = {root_turn}
        UNION SELECT root_table, {step}, depth + 1 FROM walk
          JOIN e ON {'s' if step == 't' else 't'} = walk."table" {'' if depth is None else f'WHERE depth < {depth}'})
      SELECT root_table, "table", depth FROM walk WHERE depth > 0)"""


@query("lineage_downstream", f"SELECT * FROM {_reach('t', 0, 3)}")
def lineage_downstream(spark, sf_dir):
    return lineage.downstream(edges(spark, sf_dir), _roots(spark, sf_dir, 0), 3)


@query("lineage_upstream", f"SELECT * FROM {_reach('s', 3, 2)}")
def lineage_upstream(spark, sf_dir):
    return lineage.upstream(edges(spark, sf_dir), _roots(spark, sf_dir, 3), 2)


@query("lineage_upstream_all", f"SELECT * FROM {_reach('s', 3, None)}")
def lineage_upstream_all(spark, sf_dir):
    return lineage.upstream(edges(spark, sf_dir), _roots(spark, sf_dir, 3), None)


@query("lineage_graph", f"""SELECT root_table, "table", depth, 'downstream' AS direction FROM {_reach('t', 1, 2)}
    UNION ALL SELECT root_table, "table", depth, 'upstream' FROM {_reach('s', 1, 2)}
    UNION ALL SELECT DISTINCT conv_id || ':' || turn, conv_id || ':' || turn, 0, 'root' FROM conversations WHERE turn = 1""")
def lineage_graph(spark, sf_dir):
    return lineage.graph(edges(spark, sf_dir), _roots(spark, sf_dir, 1), 2, 2)[0]


@query("lineage_graph_edges", f"""WITH n AS (SELECT "table" FROM {_reach('t', 1, 2)} UNION SELECT "table" FROM {_reach('s', 1, 2)}
      UNION SELECT conv_id || ':' || turn FROM conversations WHERE turn = 1)
    SELECT source_table, target_table FROM {_EDGES} WHERE source_table IN (SELECT "table" FROM n)
      AND target_table IN (SELECT "table" FROM n)""")
def lineage_graph_edges(spark, sf_dir):
    return lineage.graph(edges(spark, sf_dir), _roots(spark, sf_dir, 1), 2, 2)[1].select("source_table", "target_table")


@query("lineage_impact", f"""SELECT root_table, 'role' AS root_column, "table", 'line' AS "column", depth FROM {_reach('t', 0, None)}""")
def lineage_impact(spark, sf_dir):
    roots = _roots(spark, sf_dir, 0).withColumn("column", F.lit("role"))
    return lineage.impact(edges(spark, sf_dir), roots)


# -- run history ------------------------------------------------------------------------------------------------

_RUNS = """(SELECT o_orderkey AS run_id, o_custkey AS pipeline_id, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O'
    THEN 'Completed' ELSE 'Running' END AS status, o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS processed,
    o_orderkey % 5 AS failed FROM orders)"""


def run_table(spark, sf_dir):
    """Orders read as executions."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id", "o_custkey AS pipeline_id",
        "CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Completed' ELSE 'Running' END AS status",
        "o_orderdate AS started_at", "CAST(floor(o_totalprice) AS BIGINT) AS processed", "o_orderkey % 5 AS failed")


@query("runs_by_status", f"SELECT run_id, pipeline_id FROM {_RUNS} WHERE status = 'Failed' ORDER BY started_at DESC, run_id DESC")
def runs_by_status(spark, sf_dir):
    return runs.by_status(run_table(spark, sf_dir), "Failed").select("run_id", "pipeline_id")


@query("runs_by_pipeline", f"SELECT run_id, status FROM {_RUNS} WHERE pipeline_id = 42 ORDER BY started_at DESC, run_id DESC")
def runs_by_pipeline(spark, sf_dir):
    return runs.by_pipeline(run_table(spark, sf_dir), 42).select("run_id", "status")


@query("runs_latest", f"""SELECT pipeline_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id
    ORDER BY started_at DESC, run_id DESC) AS n FROM {_RUNS}) WHERE n = 1""")
def runs_latest(spark, sf_dir):
    return runs.latest(run_table(spark, sf_dir)).select("pipeline_id", "run_id", "status")


@query("runs_in_range", f"""SELECT run_id FROM {_RUNS} WHERE started_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30'""")
def runs_in_range(spark, sf_dir):
    import datetime as dt

    return runs.in_range(run_table(spark, sf_dir), dt.datetime(1998, 1, 1), dt.datetime(1998, 6, 30)).select("run_id")


@query("runs_statistics", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Completed') AS completed,
    count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'Running') AS running,
    0::BIGINT AS cancelled, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(failed) AS BIGINT) AS failed_records FROM {_RUNS}""")
def runs_statistics(spark, sf_dir):
    return runs.statistics(run_table(spark, sf_dir))


@query("runs_due", """SELECT c_custkey AS pipeline_id FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey <= 12""")
def runs_due(spark, sf_dir):
    import datetime as dt

    pipelines = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pipeline_id", "IF(c_mktsegment = 'MACHINERY', 'Running', 'Idle') AS status",
        "timestampadd(DAY, c_nationkey, TIMESTAMP '2024-01-01 00:00:00') AS next_run_at")
    return runs.due(pipelines, dt.datetime(2024, 1, 13)).select("pipeline_id")


@query("runs_metrics", """SELECT o_orderkey AS run_id, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customer FROM orders""")
def runs_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", """array(
        named_struct('name', 'price', 'value', o_totalprice),
        named_struct('name', 'customer', 'value', CAST(o_custkey AS DOUBLE))) AS metrics""")
    return runs.metrics(rows, ["price", "customer"])


@query("runs_with_pipeline", f"""SELECT r.run_id, c_name AS pipeline_name, a.n_name AS source_name, b.n_name AS destination_name
    FROM {_RUNS} r JOIN customer ON c_custkey = r.pipeline_id JOIN nation a ON a.n_nationkey = c_nationkey
    LEFT JOIN nation b ON b.n_nationkey = c_nationkey + 10""")
def runs_with_pipeline(spark, sf_dir):
    pipelines = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pipeline_id", "c_name AS name", "c_nationkey AS source_id", "c_nationkey + 10 AS destination_id")
    sources = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS source_id", "n_name AS name")
    return runs.with_pipeline(run_table(spark, sf_dir), pipelines, sources) \
        .select("run_id", "pipeline_name", "source_name", "destination_name")


@query("runs_find", f"SELECT run_id, status FROM {_RUNS} WHERE processed > 400000 AND failed = 4")
def runs_find(spark, sf_dir):
    return runs.find(run_table(spark, sf_dir), "processed > 400000 AND failed = 4").select("run_id", "status")


@query("runs_count", f"SELECT count(*) AS count FROM {_RUNS}")
def runs_count(spark, sf_dir):
    return runs.count(run_table(spark, sf_dir))


@query("runs_exists", f"SELECT count(*) > 0 AS \"exists\" FROM {_RUNS} WHERE status = 'Cancelled'")
def runs_exists(spark, sf_dir):
    return runs.exists(run_table(spark, sf_dir), "status = 'Cancelled'")
