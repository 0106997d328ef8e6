"""Joins, aggregation, reshaping, windows, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, paging, reshape
from millrace.operators.aggregates import Agg, Measure, aggregate, summarize
from millrace.operators.enrichment import enrich_from_lookup
from millrace.operators.joins import On, apply_join
from millrace.operators.windows import apply_window
from workload.registry import query, table
from workload.rules import TEXT_NUMBERS

# -- joins ------------------------------------------------------------------------------------------------------

# all customers against all orders with the buyer key moved by 100, so both sides have unmatched rows
_BUYERS = "(SELECT o_orderkey, o_custkey + 100 AS buyer, o_totalprice FROM orders)"


def _sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey + 100 AS buyer", "o_totalprice")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders


def _join(key: str, how: str):
    @query(key, f"SELECT c_custkey, c_name, o_orderkey, buyer, o_totalprice "
                f"FROM customer {how.upper()} JOIN {_BUYERS} ON c_custkey = buyer")
    def run(spark, sf_dir):
        customers, orders = _sides(spark, sf_dir)
        return apply_join(customers, orders, how, [On("c_custkey", "buyer")])

    return run


for _how in ("Inner", "Left", "Right", "Full"):
    _join(f"join_{_how.lower()}", _how)


@query("join_cross", """SELECT s_suppkey, s_name, r_regionkey, r_name FROM supplier, region""")
def join_cross(spark, sf_dir):
    # the right side is a fixed code table, so the output grows with the left side only
    return apply_join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "region"),
                      "Cross", allow_cross=True)


@query("join_multi_key", """SELECT l_orderkey, l_partkey, l_suppkey, lines, parts FROM lineitem JOIN
    (SELECT l_orderkey AS t_orderkey, l_suppkey AS t_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts FROM lineitem
     GROUP BY 1, 2) ON l_orderkey = t_orderkey AND l_suppkey = t_suppkey""")
def join_multi_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    totals = lines.groupBy(F.col("l_orderkey").alias("t_orderkey"), F.col("l_suppkey").alias("t_suppkey")) \
        .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_partkey").alias("parts"))
    return apply_join(lines, totals, "Inner", [On("l_orderkey", "t_orderkey"), On("l_suppkey", "t_suppkey")]) \
        .select("l_orderkey", "l_partkey", "l_suppkey", "lines", "parts")


def _theta(key: str, operator: str, sign: str):
    """Lines against their order with a second, non-equality comparison."""

    @query(key, f"SELECT o_orderkey, o_custkey, l_partkey, l_linenumber FROM orders JOIN lineitem "
                f"ON o_orderkey = l_orderkey AND o_orderdate {sign} l_shipdate")
    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
        joined = apply_join(orders, lines, "Inner", [On("o_orderkey", "l_orderkey"),
                                                     On("o_orderdate", "l_shipdate", operator)])
        return joined.select("o_orderkey", "o_custkey", "l_partkey", "l_linenumber")

    return run


_theta("join_not_equal", "NotEqual", "<>")
_theta("join_lt", "LessThan", "<")
_theta("join_le", "LessThanOrEqual", "<=")
_theta("join_gt", "GreaterThan", ">")
_theta("join_ge", "GreaterThanOrEqual", ">=")


@query("join_range", """SELECT event_id, o.o_orderkey FROM events e
    JOIN (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 8400 DAY AS opens,
                 o_orderdate + INTERVAL 8400 DAY + o_orderkey % 40 * INTERVAL 1 DAY AS closes FROM orders) o
    ON e.user_id = o.o_custkey AND e.ts BETWEEN o.opens AND o.closes""")
def join_range(spark, sf_dir):
    """Events of a customer while one of their (shifted) orders is open, for up to 39 days."""
    ranges = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 8400 DAYS AS opens",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 8400 DAYS + o_orderkey % 40 * INTERVAL 1 DAY AS closes")
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts")
    return joins.range_join(events, ranges, "ts", "opens", "closes", 5 * 86400, [("user_id", "o_custkey")]) \
        .select("event_id", "o_orderkey")


_NATIONS = """(SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3
    UNION ALL SELECT n_nationkey, 'ZZ duplicate' FROM nation WHERE n_nationkey = 7)"""


def _nations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nation.filter("n_nationkey <> 3").unionByName(
        nation.filter("n_nationkey = 7").withColumn("n_name", F.lit("ZZ duplicate")))


@query("enrich_lookup", f"""SELECT c_custkey, c_nationkey, n_name FROM customer JOIN
    (SELECT n_nationkey, min(n_name) AS n_name FROM {_NATIONS} GROUP BY 1) ON c_nationkey = n_nationkey""")
def enrich_lookup(spark, sf_dir):
    return enrich_from_lookup(table(spark, sf_dir, "customer"), _nations(spark, sf_dir), "c_nationkey", "n_nationkey",
                              ["n_name"]).select("c_custkey", "c_nationkey", "n_name")


@query("enrich_lookup_nulls", f"""SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN
    (SELECT n_nationkey, min(n_name) AS n_name FROM {_NATIONS} GROUP BY 1) ON c_nationkey = n_nationkey""")
def enrich_lookup_nulls(spark, sf_dir):
    return enrich_from_lookup(table(spark, sf_dir, "customer"), _nations(spark, sf_dir), "c_nationkey", "n_nationkey",
                              ["n_name"], include_null_matches=True).select("c_custkey", "c_nationkey", "n_name")


@query("anti_missing", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT buyer FROM {_BUYERS})")
def anti_missing(spark, sf_dir):
    customers, orders = _sides(spark, sf_dir)
    return joins.missing_rows(customers, orders.selectExpr("buyer AS c_custkey"), ["c_custkey"])


# -- aggregation ------------------------------------------------------------------------------------------------

def _money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def _lines(spark, sf_dir):
    """Line items with exact decimal amounts, so sums do not depend on the order of addition."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
        "CAST(l_quantity AS DECIMAL(18,2)) AS quantity", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
        "CAST(l_discount AS DECIMAL(18,2)) AS discount")


def _measure(key: str, function: str, sql: str, as_type: str = "double"):
    @query(key, f"SELECT l_returnflag, {sql} AS v FROM lineitem GROUP BY l_returnflag")
    def run(spark, sf_dir):
        out = summarize(_lines(spark, sf_dir), ["l_returnflag"], [Measure("price", function, "v")])
        return out.withColumn("v", F.round(F.col("v").cast("double"), 4))

    return run


_measure("agg_sum", "sum", f"CAST(sum({_money('l_extendedprice')}) AS DOUBLE)")
_measure("agg_avg", "avg", f"round(CAST(sum({_money('l_extendedprice')}) AS DOUBLE) / count(*), 4)")
_measure("agg_min", "min", "min(l_extendedprice)")
_measure("agg_max", "max", "max(l_extendedprice)")


@query("agg_count_values", f"""SELECT p_brand, count(try_cast(size AS DECIMAL(18,4))) AS n FROM
    (SELECT p_brand, t.size FROM part JOIN ({TEXT_NUMBERS}) t USING (p_partkey)) GROUP BY p_brand""")
def agg_count_values(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(
        "p_brand", F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"))
    return summarize(sizes, ["p_brand"], [Measure("size", "count", "n")])


@query("agg_count_rows", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_rows(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "events"), ["event_type"], {"n": Agg("Count")})


@query("agg_first", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def agg_first(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "events"), ["user_id"],
                     {"first_type": Agg("First", "event_type", order=("ts", "event_id"))})


@query("agg_last", "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def agg_last(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "events"), ["user_id"],
                     {"last_value": Agg("Last", "value", order=("ts", "event_id"))})


@query("agg_custom", f"""SELECT l_returnflag,
    CAST(sum({_money('l_extendedprice')} * (1 - {_money('l_discount')})) AS DOUBLE) AS revenue
    FROM lineitem GROUP BY l_returnflag""")
def agg_custom(spark, sf_dir):
    out = aggregate(_lines(spark, sf_dir), ["l_returnflag"],
                    {"revenue": Agg("Custom", expression="sum(price * (1 - discount))")})
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("agg_multi", f"""SELECT l_returnflag, l_linestatus, CAST(sum({_money('l_quantity')}) AS DOUBLE) AS sum_qty,
    CAST(sum({_money('l_extendedprice')}) AS DOUBLE) AS sum_price, min(l_extendedprice) AS min_price,
    max(l_extendedprice) AS max_price, count(*) AS n,
    round(CAST(sum({_money('l_quantity')}) AS DOUBLE) / count(*), 4) AS avg_qty
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_multi(spark, sf_dir):
    out = aggregate(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], {
        "sum_qty": Agg("Sum", "quantity"), "sum_price": Agg("Sum", "price"), "min_price": Agg("Min", "price"),
        "max_price": Agg("Max", "price"), "n": Agg("Count"), "avg_qty": Agg("Average", "quantity")})
    return out.select("l_returnflag", "l_linestatus", "n", *[
        F.round(F.col(c).cast("double"), 4).alias(c) for c in ("sum_qty", "sum_price", "min_price", "max_price", "avg_qty")])


@query("agg_global", f"""SELECT CAST(sum({_money('l_extendedprice')}) AS DOUBLE) AS total, count(*) AS n
    FROM lineitem HAVING count(*) > 0""")
def agg_global(spark, sf_dir):
    out = summarize(_lines(spark, sf_dir), [], [Measure("price", "sum", "total"), Measure("price", "count", "n")])
    return out.withColumn("total", F.col("total").cast("double"))


@query("pivot", f"""SELECT o_orderpriority,
    CAST(sum({_money('o_totalprice')}) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS f,
    CAST(sum({_money('o_totalprice')}) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS o,
    CAST(sum({_money('o_totalprice')}) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS p
    FROM orders GROUP BY o_orderpriority""")
def pivot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority", "lower(o_orderstatus) AS status", "CAST(o_totalprice AS DECIMAL(18,2)) AS price")
    wide = reshape.pivot(orders, ["o_orderpriority"], "status", "price", "Sum", ["f", "o", "p"])
    return wide.select("o_orderpriority", *[F.col(c).cast("double").alias(c) for c in "fop"])


@query("pivot_first", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS f,
    arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey""")
def pivot_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "lower(o_orderstatus) AS status", "o_orderkey", "o_orderdate")
    return reshape.pivot(orders, ["o_custkey"], "status", "o_orderkey", "First", ["f", "o"], order=["o_orderdate", "o_orderkey"])


@query("pivot_custom", """SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS f,
    count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def pivot_custom(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "lower(o_orderstatus) AS status", "o_custkey")
    return reshape.pivot(orders, ["o_orderpriority"], "status", function="Custom", values=["f", "p"],
                         expression="nullif(count(DISTINCT o_custkey), 0)").fillna(0, ["f", "p"])


_SHIPMENTS = "(SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'part ' || l_partkey % 500 END AS g, l_quantity, l_extendedprice FROM lineitem)"


@query("agg_quantiles", f"""SELECT g, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
    count(*) AS n FROM {_SHIPMENTS} GROUP BY g""")
def agg_quantiles(spark, sf_dir):
    """Exact quantiles of prices, where one group holds a third of the rows and is split."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE concat('part ', l_partkey % 500) END AS g", "l_extendedprice")
    out = aggregate(lines, ["g"], {"mid": Agg("Median", "l_extendedprice"), "n": Agg("Count"),
                                   "p99": Agg("Quantile", "l_extendedprice", probability=0.99)}, max_group_rows=5_000)
    return out.select("g", "n", *[F.round(c, 4).alias(c) for c in ("mid", "p99")])


@query("agg_mode", """SELECT l_suppkey, arg_min(l_partkey, (-n, l_partkey)) AS part FROM
    (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def agg_mode(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"part": Agg("Mode", "l_partkey")})


@query("pivot_median", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'F'), 4) AS f,
    round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY o_orderpriority""")
def pivot_median(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "lower(o_orderstatus) AS status", "o_totalprice")
    wide = reshape.pivot(orders, ["o_orderpriority"], "status", "o_totalprice", "Median", ["f", "p"])
    return wide.select("o_orderpriority", F.round("f", 4).alias("f"), F.round("p", 4).alias("p"))


@query("unpivot", """SELECT c_custkey, 'segment' AS name, nullif(c_mktsegment, 'BUILDING') AS value FROM customer
    UNION ALL SELECT c_custkey, 'name', c_name FROM customer""")
def unpivot(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_name AS name")
    return reshape.unpivot(customers, ["c_custkey"], ["segment", "name"], "name", "value")


# -- windows ----------------------------------------------------------------------------------------------------

def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "ts", "CAST(nullif(value, 10.0) AS DECIMAL(18,2)) AS value")


_EVENTS = ("(SELECT event_id, user_id, event_type, ts, CAST(nullif(value, 10.0) AS DECIMAL(18,2)) AS value "
           "FROM events)")


def _window(key: str, function: str, order: list[str], source: str | None, sql: str, result: str):
    @query(key, f"SELECT event_id, CAST({sql} AS {result}) AS w FROM {_EVENTS}")
    def run(spark, sf_dir):
        out = apply_window(_events(spark, sf_dir), function, ["user_id"], order, "w", source)
        spark_type = {"VARCHAR": "string"}.get(result, result.lower())
        w = F.col("w").cast(spark_type)
        return out.select("event_id", (F.round(w, 6) if function == "Average" else w).alias("w"))

    return run


_OVER = "OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST)"
_DAY = "OVER (PARTITION BY user_id ORDER BY event_type NULLS FIRST)"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_BY = ["ts", "event_id"]
_window("win_row_number", "RowNumber", _BY, None, f"row_number() {_OVER}", "INTEGER")
_window("win_rank", "Rank", ["event_type"], None, f"rank() {_DAY}", "INTEGER")
_window("win_dense_rank", "DenseRank", ["event_type"], None, f"dense_rank() {_DAY}", "INTEGER")
_window("win_lead", "Lead", _BY, "event_type", f"lead(event_type) {_OVER}", "VARCHAR")
_window("win_lag", "Lag", _BY, "value", f"lag(value) {_OVER}", "DOUBLE")
_window("win_first_value", "FirstValue", _BY, "event_type", f"first_value(event_type) {_OVER[:-1]} {_ALL}", "VARCHAR")
_window("win_last_value", "LastValue", _BY, "event_type", f"last_value(event_type) {_OVER[:-1]} {_ALL}", "VARCHAR")
_window("win_sum", "Sum", ["event_type"], "value", f"sum(value) {_DAY}", "DOUBLE")
_window("win_min", "Min", _BY, "value", f"min(value) {_OVER}", "DOUBLE")
_window("win_max", "Max", _BY, "value", f"max(value) {_OVER}", "DOUBLE")
_window("win_count", "Count", [], "value", "count(value) OVER (PARTITION BY user_id)", "BIGINT")


@query("win_avg", f"""SELECT event_id, round(CAST(sum(value) {_DAY} AS DOUBLE) / count(value) {_DAY}, 6) AS w
    FROM {_EVENTS}""")
def win_avg(spark, sf_dir):
    out = apply_window(_events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(20,8)")), "Average",
                       ["user_id"], ["event_type"], "w", "value")
    return out.select("event_id", F.round(F.col("w").cast("double"), 6).alias("w"))


@query("win_custom", f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM {_EVENTS}""")
def win_custom(spark, sf_dir):
    out = apply_window(_events(spark, sf_dir), "Custom", ["user_id"], _BY, "w", expression=(
        "count(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
    return out.select("event_id", "w")


@query("win_custom_rows", f"""SELECT event_id, max(event_id) OVER w - min(event_id) OVER w AS w, count(*) OVER w AS n FROM {_EVENTS}
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING)""")
def win_custom_rows(spark, sf_dir):
    """Frames of rows over a handful of large partitions, each cut into tiles of at most 1,000 rows."""
    out = apply_window(_events(spark, sf_dir), "Custom", ["event_type"], _BY, "ids", expression="collect_list(event_id)",
                       rows_between=(-5, 3), max_group_rows=1000)
    return out.select("event_id", (F.array_max("ids") - F.array_min("ids")).alias("w"), F.size("ids").cast("long").alias("n"))


# -- sorting and paging -----------------------------------------------------------------------------------------

@query("sort_by", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC")
def sort_by(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return paging.sort_by(customers, "C_AcctBal", ["c_name", "c_acctbal"], "c_name", "c_custkey", descending=True)


@query("page_offset", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return paging.page(orders, ["o_orderdate"], "o_orderkey", number=3, size=50)


@query("page_offset_info", """SELECT 3 AS page_number, 50 AS page_size, count(*) AS total_count,
    CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, true AS has_previous,
    3 < ceil(count(*) / 50.0) AS has_next FROM orders""")
def page_offset_info(spark, sf_dir):
    return paging.page_info(table(spark, sf_dir, "orders"), 3, 50)


@query("page_keyset", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderkey > 500) > 25
    AS has_more FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25""")
def page_keyset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return paging.page_after(orders, "o_orderkey", 500, 25)


@query("page_keyset_desc", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderkey < 900) > 100
    AS has_more FROM orders WHERE o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 100""")
def page_keyset_desc(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return paging.page_after(orders, "o_orderkey", 900, 500, descending=True)


@query("top_latest", """SELECT o_custkey, o_orderkey, o_totalprice FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    WHERE n = 1""")
def top_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return paging.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]) \
        .select("o_custkey", "o_orderkey", "o_totalprice")
