"""Schema validation, inference, quality rules, contracts and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import unnest
from millrace.operators import contracts, inference, quality_rules, schema_checks
from millrace.operators.quality_rules import QualityRule
from millrace.operators.schema_checks import DataSchema, SchemaField
from workload.registry import query, table

CUSTOMER_NULLS = """(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END
    AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""


def customer_nulls(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_nationkey", "IF(c_custkey % 5 = 0, NULL, c_acctbal) AS c_acctbal",
        "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment")


# -- schema -----------------------------------------------------------------------------------------------------

def _errors(key: str, source, keys: list[str], schema: DataSchema, sql: str):
    @query(key, sql)
    def run(spark, sf_dir):
        return schema_checks.error_list(source(spark, sf_dir), schema, keys)

    return run


def _open(*fields: SchemaField) -> DataSchema:
    return DataSchema("check", list(fields), allow_unknown=True)


_errors("schema_required", customer_nulls, ["c_custkey"],
        _open(SchemaField("c_acctbal", "Decimal", True), SchemaField("c_phone", "String", True)),
        f"""SELECT c_custkey, 'c_acctbal' AS field, 'Required field ''c_acctbal'' is missing or null' AS message
            FROM {CUSTOMER_NULLS} WHERE c_acctbal IS NULL
            UNION ALL SELECT c_custkey, 'c_phone', 'Required field ''c_phone'' is missing or null' FROM customer""")
_errors("schema_unknown", lambda s, d: table(s, d, "supplier"), ["s_suppkey"],
        DataSchema("check", [SchemaField("s_suppkey", "Integer"), SchemaField("s_name", "String"),
                             SchemaField("s_acctbal", "Decimal")]),
        """SELECT s_suppkey, 's_nationkey' AS field, 'Field ''s_nationkey'' is not defined in the schema' AS message
           FROM supplier""")


def _props(spark, sf_dir):
    """Event properties as a variant: a number, except that every seventh event holds text."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "IF(event_id % 7 = 0, '\"none\"', get_json_object(props, '$.k')) AS j", "value")
    return events.select("event_id", F.try_parse_json("j").alias("k"), F.col("value").cast("string").alias("value"))


_errors("schema_type", _props, ["event_id"],
        _open(SchemaField("k", "Integer"), SchemaField("value", "Decimal")),
        """SELECT event_id, 'k' AS field, 'Field ''k'' has invalid type. Expected Integer, got STRING' AS message
           FROM events WHERE event_id % 7 = 0
           UNION ALL SELECT event_id, 'value', 'Field ''value'' has invalid type. Expected Decimal, got String'
           FROM events""")
_errors("schema_string", lambda s, d: table(s, d, "part"), ["p_partkey"],
        _open(SchemaField("p_name", "String", constraints={"minLength": 8, "maxLength": 11, "pattern": "ing|olt"}),
              SchemaField("p_type", "String", constraints={"enum": ["SMALL", "LARGE", "MEDIUM"]})),
        """SELECT p_partkey, 'p_name' AS field, 'Field ''p_name'' length is less than minimum length of 8' AS message
           FROM part WHERE length(p_name) < 8
           UNION ALL SELECT p_partkey, 'p_name', 'Field ''p_name'' length exceeds maximum length of 11' FROM part
           WHERE length(p_name) > 11
           UNION ALL SELECT p_partkey, 'p_name', 'Field ''p_name'' does not match pattern ''ing|olt''' FROM part
           WHERE NOT regexp_matches(p_name, 'ing|olt')
           UNION ALL SELECT p_partkey, 'p_type', 'Field ''p_type'' value is not in the allowed values list' FROM part
           WHERE p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM')""")
_errors("schema_numeric", lambda s, d: table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"],
        _open(SchemaField("l_quantity", "Decimal", constraints={"minimum": 5, "maximum": 45}),
              SchemaField("l_linenumber", "Integer", constraints={"maximum": 6})),
        """SELECT l_orderkey, l_linenumber, 'l_quantity' AS field,
           'Field ''l_quantity'' value is less than minimum of 5' AS message FROM lineitem WHERE l_quantity < 5
           UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', 'Field ''l_quantity'' value exceeds maximum of 45'
           FROM lineitem WHERE l_quantity > 45
           UNION ALL SELECT l_orderkey, l_linenumber, 'l_linenumber', 'Field ''l_linenumber'' value exceeds maximum of 6'
           FROM lineitem WHERE l_linenumber > 6""")


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


_errors("schema_array", _words, ["doc_id"], _open(SchemaField("lines", "Array", constraints={"minItems": 2, "maxItems": 8})),
        """WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
           SELECT doc_id, 'lines' AS field, 'Field ''lines'' has fewer items than minimum of 2' AS message FROM d WHERE n < 2
           UNION ALL SELECT doc_id, 'lines', 'Field ''lines'' has more items than maximum of 8' FROM d WHERE n > 8""")

CUSTOMER_SCHEMA = DataSchema("customer", [
    SchemaField("c_custkey", "Integer", True), SchemaField("c_name", "String", True, {"pattern": "^Customer#\\d{9}$"}),
    SchemaField("c_nationkey", "Integer", True, {"minimum": 1, "maximum": 20}),
    SchemaField("c_acctbal", "Decimal", True, {"minimum": 0}),
    SchemaField("c_mktsegment", "String", False, {"maxLength": 9})])


_REQUIRED = "CASE WHEN c_acctbal IS NULL THEN 'Required field ''c_acctbal'' is missing or null' END"
_BOUNDS = """CASE WHEN c_nationkey < 1 THEN 'Field ''c_nationkey'' value is less than minimum of 1' END,
    CASE WHEN c_nationkey > 20 THEN 'Field ''c_nationkey'' value exceeds maximum of 20' END,
    CASE WHEN c_acctbal < 0 THEN 'Field ''c_acctbal'' value is less than minimum of 0' END,
    CASE WHEN length(c_mktsegment) > 9 THEN 'Field ''c_mktsegment'' length exceeds maximum length of 9' END"""
_SCHEMA_MESSAGES = f"concat_ws('; ', {_REQUIRED}, {_BOUNDS})"


def _joined(errors):
    return F.array_join(F.transform(errors, lambda e: e["message"]), "; ")


@query("schema_validate", f"SELECT c_custkey, {_SCHEMA_MESSAGES} AS errors FROM {CUSTOMER_NULLS}")
def schema_validate(spark, sf_dir):
    checked = schema_checks.validate(customer_nulls(spark, sf_dir), CUSTOMER_SCHEMA)
    return checked.select("c_custkey", _joined(F.col("errors")).alias("errors"))


def _flat(df):
    return df.withColumn("enum_values", F.array_join("enum_values", ","))


@query("infer_field", """WITH k AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL
      ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events)
    SELECT 'k' AS field, 'Integer' AS type, true AS required, CAST(NULL AS INTEGER) AS min_length,
    CAST(NULL AS INTEGER) AS max_length, min(k) AS minimum, max(k) AS maximum, CAST(NULL AS INTEGER) AS min_items,
    CAST(NULL AS INTEGER) AS max_items, CAST(NULL AS VARCHAR) AS enum_values FROM k""")
def infer_field(spark, sf_dir):
    return _flat(inference.infer_fields(_props(spark, sf_dir), ["k"]))


@query("infer_schema", """SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority'])
    AS field, unnest(['Integer','Integer','String','Decimal','DateTime','String']) AS type, true AS required""")
def infer_schema(spark, sf_dir):
    first = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    return inference.infer_from_record(first).select("field", "type", "required")


@query("infer_constraints", f"""
    SELECT *, CAST(NULL AS INTEGER) AS min_items, CAST(NULL AS INTEGER) AS max_items FROM (
    SELECT 'c_custkey' AS field, 'Integer' AS type, true AS required, CAST(NULL AS INTEGER) AS min_length,
      CAST(NULL AS INTEGER) AS max_length, CAST(min(c_custkey) AS DOUBLE) AS minimum, CAST(max(c_custkey) AS DOUBLE) AS maximum,
      CAST(NULL AS VARCHAR) AS enum_values FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'c_name', 'String', true, CAST(min(length(c_name)) AS INTEGER), CAST(max(length(c_name)) AS INTEGER),
      NULL, NULL, NULL FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'c_nationkey', 'Integer', true, NULL, NULL, min(c_nationkey), max(c_nationkey), NULL FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'c_acctbal', 'Decimal', false, NULL, NULL, min(c_acctbal), max(c_acctbal), NULL FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'c_mktsegment', 'String', false, CAST(min(length(c_mktsegment)) AS INTEGER),
      CAST(max(length(c_mktsegment)) AS INTEGER), NULL, NULL, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment)
      FROM {CUSTOMER_NULLS})""")
def infer_constraints(spark, sf_dir):
    return _flat(inference.infer_fields(customer_nulls(spark, sf_dir)))


@query("infer_items", """SELECT 'embedding' AS field, 'Array' AS type, true AS required, CAST(min(len(embedding)) AS INTEGER) AS min_items,
    CAST(max(len(embedding)) AS INTEGER) AS max_items FROM embeddings""")
def infer_items(spark, sf_dir):
    found = inference.infer_fields(table(spark, sf_dir, "embeddings"), ["embedding"])
    return found.select("field", "type", "required", "min_items", "max_items")


# -- rules ------------------------------------------------------------------------------------------------------

def _dq(key: str, source, keys: list[str], rule: QualityRule, sql: str):
    """Keys with the verdict of one rule."""

    @query(key, sql)
    def run(spark, sf_dir):
        out = quality_rules.validate(source(spark, sf_dir), [rule])
        return out.select(*keys, F.get("results", F.lit(0))["valid"].alias("valid"))

    return run


_dq("dq_not_null", customer_nulls, ["c_custkey"], QualityRule("balance", "NotNull", "c_acctbal"),
    f"SELECT c_custkey, c_acctbal IS NOT NULL AS valid FROM {CUSTOMER_NULLS}")
_dq("dq_regex", customer_nulls, ["c_custkey"], QualityRule("segment", "Regex", "c_mktsegment", {"pattern": "^[A-H]"}),
    f"SELECT c_custkey, coalesce(regexp_matches(c_mktsegment, '^[A-H]'), false) AS valid FROM {CUSTOMER_NULLS}")
_dq("dq_range", customer_nulls, ["c_custkey"], QualityRule("balance", "Range", "c_acctbal", {"min": 0, "max": 5000}),
    f"SELECT c_custkey, coalesce(c_acctbal BETWEEN 0 AND 5000, false) AS valid FROM {CUSTOMER_NULLS}")
_dq("dq_unique", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
    ["l_orderkey", "l_linenumber", "l_partkey"], QualityRule("one line", "Unique", "l_orderkey"),
    """SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) = 1 AS valid FROM lineitem""")


def _shipping(spark, sf_dir):
    """Order lines with the balance and price of the same row to compare, some related values null."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "IF(o_orderkey % 6 = 0, NULL, o_custkey * 300.0D) AS credit")


_dq("dq_comparison", _shipping, ["o_orderkey"], QualityRule("in credit", "Comparison", "o_totalprice",
                                                          {"operator": "ge"}, "credit"),
    """SELECT o_orderkey, coalesce(o_totalprice >= CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey * 300.0 END, true)
       AS valid FROM orders""")
_dq("dq_custom", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"),
    ["l_orderkey", "l_linenumber", "l_partkey"],
    QualityRule("rates", "Custom", "l_discount", {"expression": "l_discount + l_tax < 0.1"}),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount + l_tax < 0.1 AS valid FROM lineitem")

CUSTOMER_RULES = [
    QualityRule("segment known", "NotNull", "c_mktsegment", severity="Warning"),
    QualityRule("balance range", "Range", "c_acctbal", {"min": 0}, severity="Error"),
    QualityRule("name form", "Regex", "c_name", {"pattern": "^Customer#"}, severity="Critical"),
    QualityRule("one per nation", "Unique", "c_nationkey", severity="Info"),
]
_SEGMENT, _BALANCE = "c_mktsegment IS NULL", "(c_acctbal IS NULL OR c_acctbal < 0)"


@query("dq_validate", f"""
    SELECT c_custkey, 'segment known' AS rule, 'Warning' AS severity,
      'Validation failed for rule ''segment known'': Field ''c_mktsegment'' must not be null' AS message
      FROM {CUSTOMER_NULLS} WHERE {_SEGMENT}
    UNION ALL SELECT c_custkey, 'balance range', 'Error',
      'Validation failed for rule ''balance range'': Field ''c_acctbal'' is outside the allowed range'
      FROM {CUSTOMER_NULLS} WHERE {_BALANCE}
    UNION ALL SELECT c_custkey, 'one per nation', 'Info',
      'Validation failed for rule ''one per nation'': Field ''c_nationkey'' must be unique'
      FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n > 1""")
def dq_validate(spark, sf_dir):
    checked = quality_rules.validate(customer_nulls(spark, sf_dir), CUSTOMER_RULES)
    failed = unnest(checked, ["c_custkey"], F.filter("results", lambda r: ~r["valid"]), "rule")
    return failed.drop("valid")


@query("dq_summary", f"""
    SELECT 'segment known' AS rule, 'Warning' AS severity, count(*) FILTER (WHERE NOT {_SEGMENT}) AS passed,
      count(*) FILTER (WHERE {_SEGMENT}) AS failed FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'balance range', 'Error', count(*) FILTER (WHERE NOT {_BALANCE}), count(*) FILTER (WHERE {_BALANCE})
      FROM {CUSTOMER_NULLS}
    UNION ALL SELECT 'name form', 'Critical', count(*), 0 FROM customer
    UNION ALL SELECT 'one per nation', 'Info', count(*) FILTER (WHERE n = 1), count(*) FILTER (WHERE n > 1)
      FROM (SELECT count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def dq_summary(spark, sf_dir):
    return quality_rules.summary(customer_nulls(spark, sf_dir), CUSTOMER_RULES)


_FAILED = "Validation failed for rule ''{}'': Field ''{}'' {}"
_MESSAGES = f"""concat_ws('; ', CASE WHEN {_SEGMENT} THEN '{_FAILED.format("segment known", "c_mktsegment", "must not be null")}' END,
    CASE WHEN {_BALANCE} THEN '{_FAILED.format("balance range", "c_acctbal", "is outside the allowed range")}' END"""
_UNIQUE = f", CASE WHEN n > 1 THEN '{_FAILED.format('one per nation', 'c_nationkey', 'must be unique')}' END"


@query("dq_quarantine", f"""SELECT c_custkey, CASE WHEN {_BALANCE} THEN 'Error' WHEN {_SEGMENT} THEN 'Warning'
      WHEN n > 1 THEN 'Info' END AS severity, {_MESSAGES}{_UNIQUE}) AS messages, {_BALANCE} AS quarantined
    FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM {CUSTOMER_NULLS})""")
def dq_quarantine(spark, sf_dir):
    flagged = quality_rules.quarantine(customer_nulls(spark, sf_dir), CUSTOMER_RULES, "Error")
    return flagged.select("c_custkey", "severity", _joined(F.col("failures")).alias("messages"), "quarantined")


CONTRACT = contracts.Contract("customer", CUSTOMER_SCHEMA, CUSTOMER_RULES[:3])
_SCHEMA_ERRORS = """((c_acctbal IS NULL)::INT + (c_nationkey < 1)::INT + (c_nationkey > 20)::INT
    + coalesce((c_acctbal < 0)::INT, 0) + coalesce((length(c_mktsegment) > 9)::INT, 0))"""
_VIOLATIONS = f"(({_SEGMENT})::INT + ({_BALANCE})::INT)"


@query("contract_check", f"""SELECT c_custkey, {_SCHEMA_ERRORS} = 0 AND NOT {_BALANCE} AS is_compliant,
    {_SCHEMA_MESSAGES} AS schema_errors, {_MESSAGES}) AS rule_violations FROM {CUSTOMER_NULLS}""")
def contract_check(spark, sf_dir):
    c = F.col("compliance")
    return contracts.check(customer_nulls(spark, sf_dir), CONTRACT).select(
        "c_custkey", c["is_compliant"].alias("is_compliant"),
        _joined(c["schema_errors"]).alias("schema_errors"),
        _joined(c["rule_violations"]).alias("rule_violations"))


@query("contract_check_batch", f"""SELECT 'customer' AS contract, count(*) AS checked,
    count(*) FILTER (WHERE {_SCHEMA_ERRORS} = 0 AND NOT {_BALANCE}) AS compliant,
    CAST(sum({_SCHEMA_ERRORS}) AS BIGINT) AS schema_errors, CAST(sum({_VIOLATIONS}) AS BIGINT) AS rule_violations
    FROM {CUSTOMER_NULLS}""")
def contract_check_batch(spark, sf_dir):
    return contracts.check_batch(customer_nulls(spark, sf_dir), CONTRACT)
