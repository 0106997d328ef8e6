"""Field rules, filters and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.filters import Condition, apply_filter, filter_counts
from millrace.operators.mapping import Mapping, apply_mapping
from millrace.operators.rules import Rule, apply_rules
from workload.registry import query, table


def _rule(key: str, tbl: str, keep: list[str], rule: Rule, sql: str):
    """One rule on one table; the output is pruned to ``keep`` so only those columns are read."""

    @query(key, sql)
    def run(spark, sf_dir):
        return apply_rules(table(spark, sf_dir, tbl), [rule]).select(*keep)

    return run


_rule("rule_copy", "orders", ["o_orderkey", "status"], Rule("o_orderstatus", "status", "Copy"),
      "SELECT o_orderkey, o_orderstatus AS status FROM orders")
_rule("rule_format", "lineitem", ["l_orderkey", "l_linenumber", "shown"],
      Rule("l_extendedprice", "shown", "Format", "USD {0:N2}"),
      "SELECT l_orderkey, l_linenumber, 'USD ' || format('{:,.2f}', l_extendedprice) AS shown FROM lineitem")
_rule("rule_concat", "customer", ["c_custkey", "label"],
      Rule("c_name, c_mktsegment, missing", "label", "Concatenate", params={"separator": " / "}),
      "SELECT c_custkey, concat_ws(' / ', c_name, c_mktsegment) AS label FROM customer")
_rule("rule_split", "customer", ["c_custkey", "number"],
      Rule("c_name", "number", "Split", params={"separator": "#", "index": "1"}),
      "SELECT c_custkey, split_part(c_name, '#', 2) AS number FROM customer")
_rule("rule_replace", "part", ["p_partkey", "p_name"],
      Rule("p_name", "p_name", "Replace", params={"oldValue": "red", "newValue": "crimson"}),
      "SELECT p_partkey, replace(p_name, 'red', 'crimson') AS p_name FROM part")


@query("rule_trim", """SELECT doc_id, sha256(regexp_replace(text, '^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+|[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+$', '', 'g')) AS digest
    FROM (SELECT doc_id, ' ' || chr(160) || ' ' || text || chr(9) || ' ' AS text FROM documents)""")
def rule_trim(spark, sf_dir):
    padded = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("   "), "text", F.lit("\t ")).alias("text"))
    trimmed = apply_rules(padded, [Rule("text", "text", "Trim")])
    return trimmed.select("doc_id", F.sha2("text", 256).alias("digest"))


_rule("rule_upper", "part", ["p_partkey", "p_name"], Rule("p_name", "p_name", "Uppercase"),
      "SELECT p_partkey, upper(p_name) AS p_name FROM part")
_rule("rule_lower", "orders", ["o_orderkey", "priority"], Rule("o_orderpriority", "priority", "Lowercase"),
      "SELECT o_orderkey, lower(o_orderpriority) AS priority FROM orders")
_rule("rule_substring", "orders", ["o_orderkey", "level"],
      Rule("o_orderpriority", "level", "Substring", params={"startIndex": "2", "length": "4"}),
      "SELECT o_orderkey, substr(o_orderpriority, 3, 4) AS level FROM orders")
_rule("rule_dateformat", "orders", ["o_orderkey", "day"],
      Rule("o_orderdate", "day", "DateFormat", "ddd dd MMM yyyy HH:mm"),
      "SELECT o_orderkey, strftime(o_orderdate, '%a %d %b %Y %H:%M') AS day FROM orders")
_rule("rule_numberformat", "customer", ["c_custkey", "balance"],
      Rule("c_acctbal", "balance", "NumberFormat", "#,##0.0"),
      """SELECT c_custkey, format('{:,.1f}', CAST(CAST(c_acctbal AS DECIMAL(18,6)) AS DECIMAL(18,1))) AS balance
         FROM customer""")
_rule("rule_round", "customer", ["c_custkey", "c_acctbal"], Rule("c_acctbal", "c_acctbal", "Round"),
      "SELECT c_custkey, round_even(c_acctbal, 0) AS c_acctbal FROM customer")
_rule("rule_floor", "lineitem", ["l_orderkey", "l_linenumber", "price"], Rule("l_extendedprice", "price", "Floor"),
      "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS price FROM lineitem")
_rule("rule_ceiling", "lineitem", ["l_orderkey", "l_linenumber", "price"], Rule("l_extendedprice", "price", "Ceiling"),
      "SELECT l_orderkey, l_linenumber, ceil(l_extendedprice) AS price FROM lineitem")
_rule("rule_conditional", "orders", ["o_orderkey", "band"],
      Rule("o_totalprice", "band", "Conditional",
           params={"condition": "> 250000", "trueValue": "large", "falseValue": "small"}),
      "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS band FROM orders")


@query("rule_lookup", """SELECT c_custkey, n_name AS nation FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3""")
def rule_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_nationkey <> 3")
    rule = Rule("c_nationkey", "nation", "Lookup", params={"table": "nations", "key": "n_nationkey", "value": "n_name"})
    return apply_rules(table(spark, sf_dir, "customer"), [rule], {"nations": nations}).select("c_custkey", "nation")


_rule("rule_calculated", "lineitem", ["l_orderkey", "l_linenumber", "net"],
      Rule("l_extendedprice", "net", "Calculated",
           params={"expression": "round(l_extendedprice * (1 - l_discount), 4)"}),
      "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
_rule("rule_custom", "part", ["p_partkey", "size_class"],
      Rule("p_size", "size_class", "Custom", params={"expression": "p_size div 10"}),
      "SELECT p_partkey, CAST(p_size // 10 AS BIGINT) AS size_class FROM part")

ORDER_RULES = [
    Rule("o_orderstatus", "status", "Lowercase", order=1),
    Rule("o_orderdate", "month", "DateFormat", "yyyy-MM", order=2),
    Rule("o_totalprice", "price", "Round", order=3),
    Rule("o_totalprice", "band", "Conditional", order=4,
         params={"condition": "> 250000", "trueValue": "large", "falseValue": "small"}),
    Rule("o_orderpriority", "level", "Split", params={"separator": "-", "index": "1"}, order=5),
    Rule("o_orderkey, o_custkey", "reference", "Concatenate", params={"separator": ":"}, order=6),
]
RULES_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    lower(o_orderstatus) AS status, strftime(o_orderdate, '%Y-%m') AS month, round_even(o_totalprice, 0) AS price,
    CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS band,
    split_part(o_orderpriority, '-', 2) AS level, o_orderkey || ':' || o_custkey AS reference FROM orders"""


@query("rules_apply", RULES_SQL)
def rules_apply(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "orders"), ORDER_RULES)


def _filter(key: str, tbl: str, keep: list[str], conditions: list[Condition], sql: str):
    @query(key, sql)
    def run(spark, sf_dir):
        return apply_filter(table(spark, sf_dir, tbl), conditions).select(*keep)

    return run


_filter("filter_equals", "orders", ["o_orderkey"], [Condition("o_orderstatus", "equals", "F")],
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")


@query("filter_not_equals", """SELECT c_custkey, segment FROM
    (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
    WHERE segment IS NOT NULL AND segment <> 'MACHINERY'""")
def filter_not_equals(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment")
    return apply_filter(customers, [Condition("segment", "notEquals", "MACHINERY")])


_filter("filter_contains", "part", ["p_partkey", "p_name"], [Condition("p_name", "contains", "RING")],
        "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
_filter("filter_starts_with", "part", ["p_partkey", "p_name"], [Condition("p_name", "startsWith", "Blue")],
        "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'blue')")
_filter("filter_ends_with", "part", ["p_partkey", "p_name"], [Condition("p_name", "endsWith", "BOLT")],
        "SELECT p_partkey, p_name FROM part WHERE ends_with(lower(p_name), 'bolt')")
_filter("filter_greater_than", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"],
        [Condition("l_extendedprice", "greaterThan", "50,000.5")],
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000.5")

TEXT_NUMBERS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size FROM part"


def text_numbers(spark, sf_dir):
    """Part sizes as text, every fifth one not a number."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"))


@query("filter_less_than", f"SELECT p_partkey, size FROM ({TEXT_NUMBERS}) WHERE try_cast(size AS DECIMAL(18,4)) < 10")
def filter_less_than(spark, sf_dir):
    return apply_filter(text_numbers(spark, sf_dir), [Condition("size", "lessThan", "10")])


MANY = [Condition("l_returnflag", "notEquals", "R"), Condition("l_quantity", "greaterThan", "10"),
        Condition("l_discount", "lessThan", "0.05"), Condition("l_linenumber", "equals", "3")]
MANY_SQL = "l_returnflag <> 'R' AND l_quantity > 10 AND l_discount < 0.05 AND l_linenumber = 3"

_filter("filter_multi", "lineitem", ["l_orderkey", "l_partkey", "l_quantity"], MANY,
        f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE {MANY_SQL}")


@query("filter_multi_counts", f"""SELECT count(*) AS "OriginalCount", count(*) FILTER (WHERE {MANY_SQL}) AS "FilteredCount"
    FROM lineitem""")
def filter_multi_counts(spark, sf_dir):
    return filter_counts(table(spark, sf_dir, "lineitem"), MANY)


@query("map_rename", "SELECT o_orderkey AS id, o_orderdate AS placed FROM orders")
def map_rename(spark, sf_dir):
    return apply_mapping(table(spark, sf_dir, "orders"), [Mapping("o_orderkey", "id"), Mapping("o_orderdate", "placed")])


@query("map_text", """SELECT c_custkey AS id, upper(coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS loud,
    lower(c_name) AS quiet, trim(c_name) AS name FROM customer""")
def map_text(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return apply_mapping(customers, [
        Mapping("c_custkey", "id"), Mapping("segment", "loud", transformation="uppercase"),
        Mapping("c_name", "quiet", transformation="lowercase"), Mapping("c_name", "name", transformation="trim")])


@query("map_parse_int", f"SELECT p_partkey AS id, try_cast(size AS INTEGER) AS size FROM ({TEXT_NUMBERS})")
def map_parse_int(spark, sf_dir):
    return apply_mapping(text_numbers(spark, sf_dir),
                         [Mapping("p_partkey", "id"), Mapping("size", "size", transformation="parseInt")])


@query("map_parse_double", f"SELECT p_partkey AS id, try_cast(size AS DOUBLE) AS size FROM ({TEXT_NUMBERS})")
def map_parse_double(spark, sf_dir):
    return apply_mapping(text_numbers(spark, sf_dir),
                         [Mapping("p_partkey", "id"), Mapping("size", "size", transformation="parseDouble")])


@query("map_passthrough", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders")
def map_passthrough(spark, sf_dir):
    return apply_mapping(table(spark, sf_dir, "orders"), [
        Mapping("o_orderkey", "id", transformation="asText"), Mapping("o_orderstatus", "status", transformation="other")])


@query("map_required", """SELECT c_custkey AS id, c_mktsegment AS segment FROM customer
    WHERE c_mktsegment <> 'BUILDING'""")
def map_required(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return apply_mapping(customers, [Mapping("c_custkey", "id"), Mapping("segment", "segment", required=True)])
