"""A sample of the registered queries against their oracle at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of
from workload.registry import ORACLES, QUERIES

KEYS = ["job_run", "rules_apply", "filter_multi", "map_text", "join_full", "agg_multi", "win_sum", "page_keyset", "infer_constraints",
        "dq_validate", "profile_score", "mask_tokenize", "detect_sensitive", "enrich_entities", "cdc_sync_target", "sync_upsert",
        "lineage_impact", "runs_statistics", "stream_transform"]


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, sf, oracle, key):
    found = entry.queries()[key](spark, sf).toArrow()
    assert rows_of(found) == rows_of(oracle.sql(entry.oracle_sql()[key]).to_arrow_table())


def test_every_query_has_an_oracle():
    """Queries of optional modules are not counted."""
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["band", "month", "status", "total", "orders"] and not df.isEmpty()
