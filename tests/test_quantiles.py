"""Quantiles and modes per group against DuckDB, with plain and split groups."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles, reshape
from millrace.operators.aggregates import Agg, aggregate
from tests.conftest import rows

WANTED = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p999": 0.999, "high": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows: a third in one group, many ties, null keys, groups without numbers."""
    return spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 1, None).when(F.col("id") % 50 == 2, "none")
        .otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.when((F.col("id") % 50 == 2) | (F.col("id") % 11 == 0), None)
        .otherwise(F.when(F.col("id") % 5 == 0, 7.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 8 - 300)).alias("x"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.hash("id"), F.lit(6)).cast("string")).alias("v"), "id").cache()


def by_duckdb(df, by: str):
    t = df.toArrow()  # noqa: F841 - read by DuckDB
    parts = ", ".join(f"quantile_cont(x, {p})" for p in WANTED.values())
    found = duckdb.sql(f"SELECT {by}{parts} FROM t {'GROUP BY g' if by else ''}").fetchall()
    return sorted(found, key=str)


@pytest.mark.parametrize("limit", [5, 100, 10**6])
@pytest.mark.parametrize("accuracy", [4, 2000])
def test_quantiles(spark, skewed, limit, accuracy):
    got = quantiles.grouped_quantiles(skewed, ["g"], "x", WANTED, limit, accuracy).collect()
    expected = by_duckdb(skewed, "g, ")
    assert len(got) == len(expected) > 20
    for a, b in zip(sorted((tuple(r) for r in got), key=str), expected):
        assert a[0] == b[0] and a[1:] == (pytest.approx(b[1:], rel=1e-12) if b[1] is not None else b[1:])


@pytest.mark.parametrize("limit", [100, 10**6])
def test_quantiles_without_keys(spark, skewed, limit):
    got = quantiles.grouped_quantiles(skewed, [], "x", WANTED, limit).collect()
    assert [tuple(r) for r in got] == [pytest.approx(r, rel=1e-12) for r in by_duckdb(skewed, "")]
    assert quantiles.grouped_quantiles(skewed.filter("false"), [], "x", WANTED, limit).collect() == []
    nulls = skewed.withColumn("x", F.lit(None).cast("double"))
    assert [tuple(r) for r in quantiles.grouped_quantiles(nulls, [], "x", {"a": 0.5}, limit).collect()] == [(None,)]


def test_text_infinities_and_empty_tables(spark):
    text = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "n/a"), ("b", None)], "g string, x string")
    assert rows(quantiles.grouped_quantiles(text, ["g"], "x", {"q": 0.5})) == [("a", 1.5), ("b", None)]
    inf = float("inf")
    ends = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, inf, inf, inf)], "g string, x double")
    for limit in (2, 100):
        assert rows(quantiles.grouped_quantiles(ends, ["g"], "x", {"q": 0.2, "r": 0.9}, limit)) == [("a", 1.0, inf)]
    assert rows(quantiles.grouped_quantiles(text.filter("false"), ["g"], "x", {"q": 0.5}, 1)) == []
    with pytest.raises(ValueError, match="probabilities"):
        quantiles.grouped_quantiles(text, ["g"], "x", {"q": 1.5})


def test_modes(spark, skewed):
    t = skewed.toArrow()  # noqa: F841
    expected = duckdb.sql("""SELECT g, (SELECT v FROM t u WHERE u.g IS NOT DISTINCT FROM t.g AND v IS NOT NULL
        GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) FROM (SELECT DISTINCT g FROM t) t""").fetchall()
    assert rows(quantiles.grouped_modes(skewed, ["g"], "v")) == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert rows(quantiles.grouped_modes(skewed.filter("false"), [], "v")) == []
    assert rows(quantiles.grouped_modes(skewed.filter("v IS NULL"), [], "v")) == [(None,)]


def test_beside_other_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("a", 3.0, "w"), ("a", 8.0, "w"), (None, 5.0, None)], "g string, x double, v string")
    outputs = {"mid": Agg("Median", "x"), "n": Agg("Count"), "often": Agg("Mode", "v"), "q": Agg("Quantile", "x", probability=0.25)}
    for limit in (1, 100):
        out = aggregate(df, ["g"], outputs, limit)
        assert out.columns == ["g", "mid", "n", "often", "q"]
        assert rows(out) == [(None, 5.0, 1, None, 5.0), ("a", 3.0, 3, "w", 2.0)]
        assert rows(aggregate(df, [], outputs, limit)) == [(4.0, 4, "w", 2.5)]
    assert rows(aggregate(df.filter("false"), [], outputs)) == []
    with pytest.raises(ValueError, match="probability"):
        aggregate(df, ["g"], {"q": Agg("Quantile", "x")})


def test_pivot_of_medians(spark):
    df = spark.createDataFrame([("a", "k", 1.0), ("a", "k", 4.0), ("a", "m", 2.0), (None, "m", 9.0)], "g string, c string, x double")
    assert rows(reshape.pivot(df, ["g"], "c", "x", "Median", ["k", "m"])) == [(None, None, 9.0), ("a", 2.5, 2.0)]
    assert rows(reshape.pivot(df, ["g"], "c", "x", "Mode")) == [(None, None, 9.0), ("a", 1.0, 2.0)]
