"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import unnest
from millrace.operators import profiling, sketches
from millrace.session import new_folder
from workload.quality import CUSTOMER_NULLS, CUSTOMER_RULES, customer_nulls
from workload.registry import query, table

_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def _union(columns: list[str], body: str) -> str:
    return " UNION ALL ".join(body.replace("@", c) for c in columns)


@query("profile_counts", _union(_CUSTOMER_COLUMNS, f"""SELECT '@' AS "column", count(*) AS row_count,
    count(*) - count(@) AS null_count, count(*) FILTER (WHERE trim(CAST(@ AS VARCHAR)) = '') AS empty_count
    FROM {CUSTOMER_NULLS}"""))
def profile_counts(spark, sf_dir):
    return profiling.counts(customer_nulls(spark, sf_dir))


@query("profile_unique", _union(_LINE_COLUMNS + ["l_orderkey", "l_shipdate"],
                                """SELECT '@' AS "column", count(DISTINCT @) AS unique_count FROM lineitem"""))
def profile_unique(spark, sf_dir):
    return profiling.unique_counts(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS + ["l_orderkey", "l_shipdate"])


@query("profile_minmax", _union(["c_acctbal", "c_nationkey"], f"""SELECT '@' AS "column", CAST(min(@) AS DOUBLE) AS low,
    CAST(max(@) AS DOUBLE) AS high, round(CAST(sum(CAST(@ AS DECIMAL(18,2))) AS DOUBLE) / count(@), 4) AS mean,
    round(CAST(median(CAST(@ AS DOUBLE)) AS DOUBLE), 4) AS middle FROM {CUSTOMER_NULLS}"""))
def profile_minmax(spark, sf_dir):
    found = profiling.min_max(customer_nulls(spark, sf_dir), ["c_acctbal", "c_nationkey"])
    return found.select("column", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"),
                        F.round(F.col("avg").cast("double"), 4).alias("mean"),
                        F.round(F.col("median").cast("double"), 4).alias("middle"))


@query("profile_top_values", _union(["p_brand", "p_type", "p_name"], """SELECT '@' AS "column", value, n FROM
    (SELECT @ AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10)""")
    .replace("SELECT 'p_", "SELECT * FROM (SELECT 'p_").replace("LIMIT 10)", "LIMIT 10))"))
def profile_top_values(spark, sf_dir):
    values = profiling.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])
    return profiling.top_values(values).select("column", "value", "n")


@query("profile_statistics", _union(["l_quantity", "l_extendedprice"], """SELECT '@' AS "column",
    round(stddev_samp(x), 4) AS stddev, round(var_samp(x) / avg(x), 4) AS variance_ratio,
    round(avg(pow(x - m, 3)) / pow(stddev_pop(x), 3), 4) AS skewness,
    round(avg(pow(x - m, 4)) / pow(var_pop(x), 2) - 3, 4) AS kurtosis,
    round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.75), 4) AS p75
    FROM (SELECT @ AS x, (SELECT avg(@) FROM lineitem) AS m FROM lineitem)"""))
def profile_statistics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = profiling.statistics(lines, ["l_quantity", "l_extendedprice"])
    return found.select(
        "column", F.round("stddev", 4).alias("stddev"),
        F.round(F.col("variance") / F.col("mean"), 4).alias("variance_ratio"),
        *[F.round(c, 4).alias(c) for c in ("skewness", "kurtosis", "p25", "p75")])


_ISSUES = """(SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note,
    CASE WHEN o_orderkey % 1000 = 0 THEN 9999999.0 ELSE 1.0 END AS factor, 'EUR' AS currency FROM orders)"""


def _with_issues(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", "IF(o_orderkey % 3 = 0, o_orderpriority, NULL) AS note",
        "IF(o_orderkey % 1000 = 0, 9999999.0D, 1.0D) AS factor", "'EUR' AS currency")


@query("profile_issues", f"""SELECT 'note' AS "column", 'HighNullRatio' AS issue, 'Warning' AS severity,
      round(1 - count(note) / count(*), 6) AS confidence FROM {_ISSUES}
    UNION ALL SELECT 'currency', 'ConstantColumn', 'Info', 1.0
    UNION ALL SELECT 'o_custkey', 'DuplicateKey', 'Error', round(1 - count(DISTINCT o_custkey) / count(*), 6) FROM {_ISSUES}
    UNION ALL SELECT 'factor', 'Outliers', 'Warning', round(count(*) FILTER (WHERE factor > 1) / count(*), 6) FROM {_ISSUES}""")
def profile_issues(spark, sf_dir):
    orders = _with_issues(spark, sf_dir)
    found = profiling.issues(orders, profiling.profile(orders), ["o_orderkey", "o_custkey"])
    return found.withColumn("confidence", F.round("confidence", 6))


@query("profile_anomalies", """WITH base AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
      s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, avg(o_totalprice) m, stddev_samp(o_totalprice) sd FROM base),
      t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_totalprice * 5
            ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders)
    SELECT o_orderkey, 'price' AS "column", 'UnexpectedNull' AS anomaly FROM t WHERE price IS NULL
    UNION ALL SELECT o_orderkey, 'price', 'OutOfRange' FROM t, s WHERE price < lo OR price > hi
    UNION ALL SELECT o_orderkey, 'price', 'Outlier' FROM t, s WHERE abs(price - m) > 3 * sd
    UNION ALL SELECT o_orderkey, 'status', 'UnknownValue' FROM t WHERE status = 'X'
    UNION ALL SELECT o_orderkey, 'status', 'OutOfRange' FROM t WHERE status = 'X'""")
def profile_anomalies(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = orders.filter("o_orderkey % 2 = 0").selectExpr("o_totalprice AS price", "o_orderstatus AS status")
    later = orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_totalprice * 5 "
        "ELSE o_totalprice END AS price", "IF(o_orderkey % 17 = 0, 'X', o_orderstatus) AS status")
    found = profiling.anomalies(later, profiling.profile(base), ["price", "status"])
    return unnest(found, ["o_orderkey"], F.col("anomalies"), "anomaly")


_SCORES = f"""SELECT 1 - (5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal)
      - count(c_mktsegment)) / (5.0 * count(*)) AS completeness,
    (count(DISTINCT c_custkey) / count(c_custkey) + count(DISTINCT c_name) / count(c_name)
      + count(DISTINCT c_nationkey) / count(c_nationkey) + count(DISTINCT c_acctbal) / count(c_acctbal)
      + count(DISTINCT c_mktsegment) / count(c_mktsegment)) / 5.0 AS uniqueness,
    (count(c_mktsegment) + count(*) FILTER (WHERE c_acctbal >= 0) + count(*)) / (3.0 * count(*)) AS validity
    FROM {CUSTOMER_NULLS}"""


@query("profile_score", f"""SELECT metric, round(score, 6) AS score FROM (
    SELECT unnest(['completeness', 'uniqueness', 'validity', 'overall']) AS metric,
           unnest([completeness, uniqueness, validity, (completeness + uniqueness + validity) / 3]) AS score
    FROM ({_SCORES}))""")
def profile_score(spark, sf_dir):
    customers = customer_nulls(spark, sf_dir)
    rated = profiling.scores(customers, rules=CUSTOMER_RULES[:3])
    return rated.withColumn("score", F.round("score", 6))


_REPORT = f"""
      SELECT 'profile' AS section, '@' AS "column", 'row_count' AS metric, CAST(NULL AS VARCHAR) AS text, CAST(count(*) AS DOUBLE) AS number
        FROM {CUSTOMER_NULLS}
      UNION ALL SELECT 'profile', '@', 'null_count', NULL, count(*) - count(@) FROM {CUSTOMER_NULLS}
      UNION ALL SELECT 'profile', '@', 'empty_count', NULL, 0
      UNION ALL SELECT 'profile', '@', 'unique_count', NULL, count(DISTINCT @) FROM {CUSTOMER_NULLS}"""
_REPORT_NUMBERS = f""" UNION ALL SELECT 'profile', '@', metric, NULL, round(CAST(x AS DOUBLE), 4) FROM (
      SELECT unnest(['min', 'max', 'avg', 'median']) AS metric, unnest([CAST(min(@) AS DOUBLE), CAST(max(@) AS DOUBLE),
        CAST(sum(CAST(@ AS DECIMAL(18,2))) AS DOUBLE) / count(@), median(CAST(@ AS DOUBLE))]) AS x FROM {CUSTOMER_NULLS})"""
_REPORT_TEXTS = f""" UNION ALL SELECT 'profile', '@', metric, x, NULL FROM (
      SELECT unnest(['min', 'max', 'avg', 'median']) AS metric, unnest([min(@), max(@), NULL, NULL]) AS x FROM {CUSTOMER_NULLS})"""


@query("profile_report", " UNION ALL ".join(
    (_REPORT + (_REPORT_TEXTS if c in ("c_name", "c_mktsegment") else _REPORT_NUMBERS)).replace("@", c) for c in _CUSTOMER_COLUMNS)
    + f""" UNION ALL SELECT 'issue', 'c_nationkey', 'DuplicateKey', 'Error', NULL
      UNION ALL SELECT 'score', NULL, unnest(['completeness', 'uniqueness', 'validity', 'overall']), NULL, unnest([round(completeness, 4),
        round(uniqueness, 4), round(validity, 4), round((completeness + uniqueness + validity) / 3, 4)]) FROM ({_SCORES})""")
def profile_report(spark, sf_dir):
    lines = profiling.report(customer_nulls(spark, sf_dir), CUSTOMER_RULES[:3], ["c_custkey", "c_nationkey"])
    number = F.round(F.col("value").try_cast("double"), 4)
    return lines.select("section", "column", "metric", F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))


@query("profile_sketches", """SELECT 'l_partkey' AS "column", count(*) AS row_count, count(*) - count(l_partkey) AS null_count,
    CAST(min(l_partkey) AS DOUBLE) AS low, CAST(max(l_partkey) AS DOUBLE) AS high, TRUE AS unique_near, TRUE AS median_near FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(*), count(*) - count(l_extendedprice), min(l_extendedprice), max(l_extendedprice), TRUE, TRUE
    FROM lineitem""")
def profile_sketches(spark, sf_dir):
    """Sketches stored by return flag and status, merged, and held against exact values: distinct values within 4 %, the
    median within 1.5 % of its rank."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey", "l_extendedprice")
    path = new_folder(spark, "profile-sketches")
    sketches.build(lines, ["l_returnflag", "l_linestatus"]).write.parquet(path)
    told = sketches.describe(sketches.merge(spark.read.parquet(path)))
    columns = ["l_partkey", "l_extendedprice"]
    exact = profiling.unique_counts(lines, columns).withColumnRenamed("unique_count", "exact") \
        .join(profiling.quantiles(lines, columns, {"lo": 0.485, "hi": 0.515}), "column")
    return told.join(exact, "column").select(
        "column", "row_count", "null_count", "low", "high",
        (F.abs(F.col("unique_count") / F.col("exact") - 1) < 0.04).alias("unique_near"), F.col("median").between(F.col("lo"), F.col("hi")).alias("median_near"))
