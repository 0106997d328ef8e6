"""Stored sketches: merged parts against the whole table and exact values."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches
from tests.conftest import rows


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(30_000).select(
        (F.col("id") % 5).alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("k"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), F.floor(F.log2(F.col("id") + 1)))).alias("v"),
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("x"), F.lit(None).cast("double").alias("none")).cache()


def test_merged_parts_describe_the_table(spark, days):
    told = {r["column"]: r for r in sketches.describe(sketches.merge(sketches.build(days, ["day"])), k=3).collect()}
    whole = {r["column"]: r for r in sketches.describe(sketches.build(days.drop("day")), k=3).collect()}
    assert set(told) == set(whole) == {"k", "v", "x", "none"}
    unique = days.agg(*[F.count_distinct(c) for c in ("k", "v")]).first()
    assert told["k"]["unique_count"] == whole["k"]["unique_count"] == pytest.approx(unique[0], rel=0.04)
    assert told["v"]["unique_count"] == unique[1] and told["none"]["unique_count"] == 0
    assert [told[c]["null_count"] for c in ("k", "v", "x", "none")] == [0, 10_000, 0, 30_000]
    assert all(r["row_count"] == 30_000 for r in told.values())
    for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        assert told["x"][name] == pytest.approx(30_000 * p, abs=450) and told["v"][name] is None and told["none"][name] is None
    # few distinct values: counts are exact, nulls are no items
    exact = days.filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count")).limit(3).collect()
    assert [tuple(t) for t in told["v"]["top"]] == [tuple(r) for r in exact] and told["none"]["top"] == []
    assert (told["x"]["low"], told["x"]["high"]) == (1.0, 29_999.0)


def test_a_new_part_costs_only_its_own_rows(spark, days):
    stored = sketches.build(days.filter("day < 4"), ["day"])
    later = stored.unionByName(sketches.build(days.filter("day = 4"), ["day"]))
    every = sketches.build(days, ["day"])
    pick = ["column", "row_count", "null_count", "unique_count", "low", "high"]
    assert rows(sketches.describe(sketches.merge(later)), *pick) == rows(sketches.describe(sketches.merge(every)), *pick)
    by_day = sketches.describe(sketches.merge(later, ["day"]))
    assert by_day.count() == 20 and by_day.filter("row_count <> 6000").isEmpty()


def test_empty_tables(spark, days):
    nothing = days.filter("false")
    assert sketches.build(nothing, ["day"]).count() == 0 and sketches.build(nothing).count() == 0
    assert sketches.describe(sketches.merge(sketches.build(nothing, ["day"]))).count() == 0
