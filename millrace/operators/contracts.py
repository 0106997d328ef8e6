"""Data contracts: a schema and rules checked together."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, functions as F

from millrace.functions.columns import field
from millrace.operators.quality_rules import QualityRule, prepare, rule_results
from millrace.operators.schema_checks import DataSchema, schema_errors


@dataclass(frozen=True)
class Contract:
    name: str
    schema: DataSchema
    rules: list[QualityRule] = dc_field(default_factory=list)


def check(df: DataFrame, contract: Contract, target: str = "compliance") -> DataFrame:
    """Rows with ``struct<is_compliant, schema_errors, rule_violations>``.

    A row complies when it has no schema error and no failed rule of severity Error or Critical. Only failed
    rules are listed.
    """
    columns = df.columns
    ready = prepare(df, contract.rules)
    failed = F.filter(rule_results(ready, contract.rules), lambda r: ~r["valid"])
    marked = ready.select(*[field(c) for c in columns], schema_errors(df, contract.schema).alias("__schema"),
                          failed.alias("__rules"))
    blocking = F.exists("__rules", lambda r: r["severity"].isin("Error", "Critical"))
    compliant = (F.size("__schema") == 0) & ~blocking
    return marked.select(*[field(c) for c in columns], F.struct(
        compliant.alias("is_compliant"), F.col("__schema").alias("schema_errors"),
        F.col("__rules").alias("rule_violations")).alias(target))


def check_batch(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: rows checked, compliant rows, schema errors and rule violations."""
    checked = check(df, contract)
    c = F.col("compliance")
    return checked.agg(
        F.lit(contract.name).alias("contract"), F.count(F.lit(1)).alias("checked"),
        F.count_if(c["is_compliant"]).alias("compliant"),
        F.sum(F.size(c["schema_errors"]).cast("bigint")).alias("schema_errors"),
        F.sum(F.size(c["rule_violations"]).cast("bigint")).alias("rule_violations"),
    )
