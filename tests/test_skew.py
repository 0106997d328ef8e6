"""Heavy groups: every split path must give what the plain plan gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, consistency, lineage, paging, profiling, quality_rules, skew
from millrace.operators.enrichment import enrich_from_lookup
from millrace.operators.joins import On, apply_join
from millrace.operators.windows import apply_window, number_rows
from tests.conftest import rows

SPLIT = 20  # groups above 20 rows are split


@pytest.fixture(autouse=True, scope="module")
def no_broadcast(spark):
    """Small test tables would be broadcast, which needs no splitting."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def hot(spark):
    """900 rows; key 1 holds a third, the null key a third, the rest is spread; plenty of ties and null values."""
    return spark.range(900).repartition(5).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50).alias("k"),
        F.expr("nullif(id % 37, 5)").alias("o"),
        F.expr("CAST(nullif(id % 11, 3) AS DOUBLE)").alias("v"))


def test_heavy_keys_finds_only_the_large_groups(hot):
    found = [r["h"] for r in skew.heavy_groups(hot, ["k"], SPLIT).table.collect()]
    counted = hot.groupBy("k").count().filter(f"count > {SPLIT}").select(skew.key_hash(hot, ["k"]).alias("h"))
    assert sorted(found) == sorted(r["h"] for r in counted.collect())
    assert not skew.heavy_groups(hot, ["k"])


WINDOWS = [
    ("RowNumber", ["o", "id"], None), ("Rank", ["o"], None), ("DenseRank", ["o"], None),
    ("Lead", ["o", "id"], "v"), ("Lag", ["o", "id"], "v"),
    ("FirstValue", ["o", "id"], "v"), ("LastValue", ["o", "id"], "v"),
    ("Sum", ["o"], "v"), ("Average", ["o"], "v"), ("Min", ["o"], "v"), ("Max", ["o"], "v"), ("Count", ["o"], "v"),
    ("Count", ["o"], None), ("Sum", [], "v"), ("Average", [], "v"), ("Count", [], None),
]


@pytest.mark.parametrize("partition,function,order,source", [
    *[(["k"], *w) for w in WINDOWS], *[([], *w) for w in WINDOWS if w[0] in ("RowNumber", "Lag", "LastValue", "Count")]])
def test_split_window_equals_plain_window(hot, partition, function, order, source):
    plain = apply_window(hot, function, partition, order, "w", source)
    split = apply_window(hot, function, partition, order, "w", source, max_group_rows=SPLIT)
    assert split.schema["w"].dataType == plain.schema["w"].dataType

    def shown(df):
        return rows(df.select("id", F.round("w", 9) if function == "Average" else "w"))

    assert shown(split) == shown(plain)


def test_row_numbers_of_identical_rows_are_a_permutation(spark):
    same = spark.range(500).repartition(7).select(F.lit(1).alias("k"), F.lit("x").alias("o"))
    numbered = number_rows(same, ["k"], ["o"], "n", 30)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 501))


@pytest.mark.parametrize("how", ["Inner", "Left", "Right", "Full"])
@pytest.mark.parametrize("extra", [False, True])
def test_split_join_equals_plain_join(spark, hot, how, extra):
    right = spark.range(120).select(
        F.when(F.col("id") < 60, 1).when(F.col("id") < 70, None).otherwise(F.col("id")).alias("rk"), F.col("id").alias("rid"))
    left = hot.filter("id < 300").withColumn("k", F.col("k").cast("bigint"))
    right = right.withColumn("rk", F.col("rk").cast("bigint"))
    on = [On("k", "rk")] + ([On("id", "rid", "GreaterThan")] if extra else [])
    plain = apply_join(left, right, how, on)
    split = apply_join(left, right, how, on, max_group_rows=SPLIT)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)


@pytest.mark.parametrize("keep", [False, True])
def test_split_lookup_equals_plain_lookup(spark, hot, keep):
    lookup = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "n")], "key int, label string")
    plain = enrich_from_lookup(hot, lookup, "k", "key", ["label"], keep)
    split = enrich_from_lookup(hot, lookup, "k", "key", ["label"], keep, max_group_rows=SPLIT)
    assert rows(split) == rows(plain)
    assert split.filter("label = 'b'").isEmpty()


def test_split_unique_rule(hot):
    rule = quality_rules.QualityRule("u", "Unique", "k")
    plain = quality_rules.validate(hot, [rule]).select("id", F.col("results")[0]["valid"])
    split = quality_rules.validate(hot, [rule], max_group_rows=SPLIT).select("id", F.col("results")[0]["valid"])
    expected = {r["k"] for r in hot.groupBy("k").count().filter("count = 1").collect()}
    assert rows(split) == rows(plain)
    assert {r["k"] for r in hot.join(split.filter("`results[0].valid`"), "id").collect()} == expected


def test_split_upsert_and_change_apply(spark, hot):
    source = spark.createDataFrame([(1, 7, 1.5), (999, 8, 2.5), (None, 9, 3.5)], "k bigint, o bigint, v double")
    target = hot.select(F.col("k").cast("bigint").alias("k"), "o", "v", "id")
    plain = consistency.upsert(source, target, ["k"])
    split = consistency.upsert(source, target, ["k"], max_group_rows=SPLIT)
    assert rows(split) == rows(plain)
    assert split.filter("k = 999").count() == 1 and split.filter("k IS NULL AND v <> 3.5").isEmpty()
    log = spark.createDataFrame([("delete", 1, "a", 1, None), ("update", 1, "a", 4, (4, 1, 2.0, 5))],
                                "op string, ts int, txn string, k bigint, after struct<k:bigint,o:bigint,v:double,id:bigint>")
    assert rows(changes.apply(target, log, ["k"], SPLIT)) == rows(changes.apply(target, log, ["k"]))


@pytest.mark.parametrize("open_brackets", [False, True])
def test_split_quantiles(spark, hot, monkeypatch, open_brackets):
    if open_brackets:  # a sketch that is always wrong must not change the answer
        monkeypatch.setattr(profiling.F, "percentile_approx", lambda column, ps, accuracy: F.array(*[F.lit(1e9)] * 8))
    df = hot.select("id", "v", F.lit(None).cast("double").alias("none"), F.lit(3).alias("same"))
    exact = {r["column"]: r for r in profiling.quantiles(
        df, df.columns, {"a": 0.5, "b": 0.25, "c": 1.0, "d": 0.0}, max_group_rows=50).collect()}
    assert tuple(exact["id"])[1:] == (449.5, 224.75, 899.0, 0.0)
    assert tuple(exact["same"])[1:] == (3.0, 3.0, 3.0, 3.0) and "none" not in exact
    expected = df.agg(*[F.percentile("v", p) for p in (0.5, 0.25, 1.0, 0.0)]).first()
    assert tuple(exact["v"])[1:] == tuple(expected)


def test_split_lineage_walk(spark):
    edges = spark.range(300).select(
        F.lit("hub").alias("source_table"), F.concat(F.lit("t"), "id").alias("target_table")).unionByName(
        spark.createDataFrame([("t1", "hub"), ("t2", "end"), ("t3", "end")], "source_table string, target_table string"))
    roots = spark.createDataFrame([("hub",), ("t1",)], "table string")
    plain = lineage.downstream(edges, roots, 3)
    split = lineage.downstream(edges, roots, 3, max_group_rows=SPLIT)
    assert rows(split) == rows(plain)
    assert plain.filter("root_table = 'hub' AND table = 'end'").first()["depth"] == 2


def test_deep_page(spark, monkeypatch):
    df = spark.range(1000).repartition(6)
    monkeypatch.setattr(paging, "_DEEP", 100)
    assert [r["id"] for r in paging.page(df, [], "id", 31, 20).collect()] == list(range(600, 620))


@pytest.mark.parametrize("dtype", ["int", "bigint", "decimal(10,2)"])
def test_hot_key_is_split_after_a_shuffle_on_it(spark, dtype):
    """All rows of the key lie in one partition, most of them are equal, and the key types differ."""
    left = spark.range(900).selectExpr("CAST(id % 3 AS INT) AS k", "id % 2 AS same").repartition(8, "k")
    right = spark.range(40).selectExpr(f"CAST(id % 4 AS {dtype}) AS rk", "id AS r")
    on = [On("k", "rk")]
    assert rows(apply_join(left, right, "Full", on, max_group_rows=SPLIT)) == rows(apply_join(left, right, "Full", on))
    big = skew.numbered(left, "__lid")
    spread = skew.tiles(skew.heavy_groups(big, ["k"], SPLIT), skew.NONE, SPLIT)
    assert {r["left"] for r in spread.table.collect()} == {15}
    dealt = big.select(F.pmod(F.xxhash64("__lid"), F.lit(15)).alias("t")).groupBy("t").count().collect()
    assert len(dealt) == 15 and max(r["count"] for r in dealt) < 3 * 900 / 15


def test_many_hot_keys_each_with_a_small_share(spark):
    df = spark.range(42_000).selectExpr("id % 2000 AS k", "id AS v")
    assert skew.heavy_groups(df, ["k"], SPLIT).groups == 2000
    plain = apply_window(df, "RowNumber", ["k"], ["v"], "w")
    split = apply_window(df, "RowNumber", ["k"], ["v"], "w", max_group_rows=SPLIT)
    assert plain.exceptAll(split).isEmpty() and split.count() == 42_000


def test_split_average_of_decimals_is_exact(spark):
    df = spark.range(200).selectExpr("id % 2 AS k", "id % 5 AS o", "CAST(99999999999999.99 AS DECIMAL(18,2)) AS v")
    plain = apply_window(df, "Average", ["k"], ["o"], "w", "v")
    split = apply_window(df, "Average", ["k"], ["o"], "w", "v", max_group_rows=SPLIT)
    assert split.schema["w"].dataType == plain.schema["w"].dataType and rows(split) == rows(plain)


def test_unique_rules_scan_the_table_a_fixed_number_of_times(spark, tmp_path):
    spark.range(300).selectExpr("id % 3 AS a", "id AS b", "nullif(id, 1) AS c", "CAST(id % 7 AS DOUBLE) AS d").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def scans(n):
        rules = [quality_rules.QualityRule(c, "Unique", c) for c in "abcd"[:n]]
        plan = quality_rules.validate(df, rules)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")

    assert scans(1) == scans(4) == 1
    checked = quality_rules.validate(df, [quality_rules.QualityRule(c, "Unique", c) for c in "abcd"], max_group_rows=SPLIT)
    assert [tuple(r["valid"] for r in row["results"]) for row in checked.select("results").distinct().collect()] == [(False, True, True, False)]


def test_window_custom_uses_its_fields(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k int, o int, v int")
    assert rows(apply_window(df, "Custom", ["k"], ["o"], "w", expression="sum(v)"), "w") == [(11,), (5,), (7,)]
    assert rows(apply_window(df, "Custom", ["k"], [], "w", expression="max(v)"), "w") == [(6,), (6,), (7,)]


def test_impact_walks_to_the_end_of_chains_and_cycles(spark):
    steps = [(f"t{i}", f"t{i + 1}") for i in range(12)] + [("t12", "t5")]
    edges = spark.createDataFrame(steps, "source_table string, target_table string").selectExpr(
        "*", "array(struct('c' AS target_column, array('c') AS depends_on)) AS columns")
    roots = spark.createDataFrame([("t0", "c")], "table string, column string")
    found = lineage.impact(edges, roots)
    assert rows(found.filter("depth >= 9"), "table", "depth") == [("t10", 10), ("t11", 11), ("t12", 12), ("t9", 9)] and found.count() == 12
    assert lineage.impact(edges, roots, 3).count() == 3


@pytest.mark.parametrize("frame,keys,limit", [((-2, 0), ["k"], 1), ((0, 0), ["k"], 4), ((-3, 5), ["k"], 4), ((2, 4), ["k"], 25),
                                              ((-9, -4), ["k"], 7), ((-40, 40), ["k"], 4), ((-3, 5), [], 8)])
def test_split_frames_equal_plain_frames(spark, frame, keys, limit):
    """Bounded frames on either side of their row, with tiles smaller and larger than they are."""
    df = spark.range(90).selectExpr("id AS n", "IF(id < 60, 'big', IF(id < 80, null, 'small')) AS k", "IF(id % 7 = 0, null, id) AS v",
                                    "IF(id % 11 = 0, null, id % 5) AS o")
    for function, extra in (("Sum", {"source": "v"}), ("Custom", {"expression": "collect_list(n)"})):
        plain = apply_window(df, function, keys, ["o", "n"], "w", rows_between=frame, **extra)
        split = apply_window(df, function, keys, ["o", "n"], "w", rows_between=frame, max_group_rows=limit, **extra)
        assert rows(split, "n", "k", "w") == rows(plain, "n", "k", "w")


def test_frames_that_make_no_sense(spark):
    df = spark.createDataFrame([("a", 1, 5)], "k string, o int, v int")
    for function, order, frame in (("Rank", ["o"], (-1, 0)), ("Sum", [], (-1, 0)), ("Sum", ["o"], (1, 0))):
        with pytest.raises(ValueError):
            apply_window(df, function, ["k"], order, "w", "v", rows_between=frame)
