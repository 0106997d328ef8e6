"""Job specs: source, ordered steps and destination as JSON, compiled to one lazy DataFrame plan.

A spec names what JSON cannot hold: tables that steps join or look up, and Python functions (``"call": name``) of Custom
rules, masks and calculated fields and of the steps ``by_key``, ``function`` and ``predict``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import (contracts, enrichment, joins, phrases, profiling, quality_rules, reshape, schema_checks,
                                table_functions, windows)
from millrace.operators.aggregates import Agg, Measure, aggregate, summarize
from millrace.operators.filters import apply_filter
from millrace.operators.mapping import apply_mapping
from millrace.operators.masking import Mask, mask_data
from millrace.operators.rules import apply_rules
from millrace.sources import readers, sinks


@dataclass(frozen=True)
class Step:
    type: str
    config: dict


@dataclass(frozen=True)
class Job:
    name: str
    source: dict
    steps: list[Step] = dc_field(default_factory=list)
    destination: dict | None = None

    @classmethod
    def from_dict(cls, spec: dict) -> "Job":
        return cls(spec["name"], spec["source"], [Step(s["type"], s.get("config", {})) for s in spec.get("steps", [])],
                   spec.get("destination"))

    @classmethod
    def from_json(cls, text: str) -> "Job":
        return cls.from_dict(json.loads(text))


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """A source is ``{"table": …}``, ``{"query": …, "params": …}`` or ``{"format": …, "path": …, "options": …}``."""
    if "table" in source:
        return spark.table(source["table"])
    if "query" in source:
        return readers.query(spark, source["query"], source.get("params"))
    if source.get("format") == "json" and source.get("multi_line", False):
        return readers.json(spark, source["path"])
    if source.get("format") == "jdbc":
        return readers.jdbc(spark, source["kind"], source["url"], **source.get("options", {}))
    return spark.read.format(source.get("format", "parquet")).options(**source.get("options", {})).load(source["path"])


Tables = dict[str, DataFrame]
Functions = dict[str, Callable]
STEPS: dict[str, Callable[[DataFrame, dict, Tables], DataFrame]] = {
    "filter": lambda df, c, t: apply_filter(df, c["conditions"]),
    "rules": lambda df, c, t: apply_rules(df, c["rules"], t),
    "transform": lambda df, c, t: apply_mapping(df, c["mappings"]),
    "summarize": lambda df, c, t: summarize(df, c.get("group_by", []), [Measure(**m) for m in c["measures"]]),
    "aggregate": lambda df, c, t: aggregate(df, c.get("group_by", []), {
        n: Agg(**{**a, "order": tuple(a.get("order", ()))}) for n, a in c["outputs"].items()}),
    "join": lambda df, c, t: joins.apply_join(df, t[c["table"]], c.get("how", "Inner"), c.get("on"),
                                              c.get("allow_cross", False)),
    "pivot": lambda df, c, t: reshape.pivot(df, **c),
    "unpivot": lambda df, c, t: reshape.unpivot(df, **c),
    "window": lambda df, c, t: windows.apply_window(df, **c),
    "mask": lambda df, c, t: mask_data(df, {n: Mask(**m) for n, m in c["masks"].items()}),
    "calculate": lambda df, c, t: enrichment.enrich_calculated(df, **c),
    "entities": lambda df, c, t: enrichment.enrich_entities(df, **c),
    "sentiment": lambda df, c, t: enrichment.enrich_sentiment(df, **c),
    "names": lambda df, c, t: enrichment.enrich_names(
        df, c["text"], c["names"] if "names" in c else phrases.lexicon(t[c["table"]], c["columns"]), c.get("target", "names"),
        c.get("overlaps", False)),
    "lookup": lambda df, c, t: enrichment.enrich_from_lookup(
        df, t[c["table"]], c["source_key"], c["lookup_key"], c["value_fields"], c.get("include_null_matches", False)),
    "by_key": lambda df, c, t: enrichment.enrich_by_key(df, c["key"], c["call"], c["schema"]),
    "function": lambda df, c, t: enrichment.enrich_function(df, c["call"], c["schema"], c.get("params")),
    "predict": lambda df, c, t: enrichment.enrich_prediction(
        df, c["call"], c.get("input_fields", []), c.get("target", "prediction"), c.get("output", "double")),
    "sessions": lambda df, c, t: table_functions.sessions(df, **c),
    "contract": lambda df, c, t: contracts.check(df, contracts.Contract(
        c["name"], schema_checks.DataSchema.from_dict(c["schema"]),
        [quality_rules.QualityRule.from_dict(r) for r in c.get("rules", [])])),
    "profile": lambda df, c, t: profiling.profile(df, **c),
    "validate": lambda df, c, t: schema_checks.validate(df, schema_checks.DataSchema.from_dict(c["schema"])),
    "quality": lambda df, c, t: quality_rules.validate(df, [quality_rules.QualityRule.from_dict(r) for r in c["rules"]]),
}


def _with_calls(config, functions: Functions):
    """The config with every ``call`` that is a name replaced by the function of that name."""
    if isinstance(config, list):
        return [_with_calls(c, functions) for c in config]
    if not isinstance(config, dict):
        return config
    out = {}
    for key, value in config.items():
        if key == "call" and isinstance(value, str):
            if value not in functions:
                raise ValueError(f"unknown function {value!r}")
            value = functions[value]
        out[key] = _with_calls(value, functions)
    return out


def compile_job(spark: SparkSession, job: Job, tables: Tables | None = None, functions: Functions | None = None) -> DataFrame:
    """The plan of the whole job. ``tables`` are the DataFrames that join and lookup steps name, ``functions`` the Python
    functions (or, for ``predict``, MLlib models) that steps call."""
    df = read_source(spark, job.source)
    for position, step in enumerate(job.steps, 1):
        kind = step.type.lower()
        if kind not in STEPS:
            raise ValueError(f"step {position}: unknown type {step.type!r}")
        df = STEPS[kind](df, _with_calls(step.config, functions or {}), tables or {})
    return df


def run_job(spark: SparkSession, job: Job, tables: Tables | None = None, records: str | None = None,
            keep_going: bool = False, functions: Functions | None = None) -> DataFrame:
    """Compile, write to the destination in one action, and return the run record (one row).

    A failed run has the status Failed, no processed rows and the error's message. ``records`` is a folder to which
    the record is appended. After that a failure is raised, unless ``keep_going`` is set.
    """
    started = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    rows, failure = 0, None
    try:
        plan, target = compile_job(spark, job, tables, functions), job.destination or {}
        if "table" in target:
            rows = sinks.load_table(plan, target["table"], target.get("create", False), target.get("truncate", False),
                                    target.get("path"))
        else:
            rows = sinks.write_files(plan, target["path"], target.get("format", "parquet"), target.get("mode", "append"),
                                     target.get("metadata", False))
    except Exception as error:  # noqa: BLE001 - whatever stops a run is recorded
        failure = error
    record = spark.range(1).select(
        F.lit(job.name).alias("job"), F.lit("Failed" if failure else "Completed").alias("status"),
        F.lit(started).alias("started_at"), F.current_timestamp().alias("ended_at"),
        F.lit(rows).cast("bigint").alias("processed"),
        F.lit(str(failure) if failure else None).cast("string").alias("message"))
    if records:
        record.write.mode("append").parquet(records)
    if failure and not keep_going:
        raise failure
    return record
