"""Checksums and hash trees: equal for equal tables only, and differences read and shuffle what differs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, consistency, hashtree
from tests.conftest import rows


def checksum(df, columns=None):
    return tuple(consistency.checksum(df, columns).first())


def test_different_rows_have_different_checksums(spark):
    """Separators and null tags within values; parts that move between fields; maps, arrays, structs, binaries."""
    values = [None, "", "-", "a", "a\u001fb", "\u0000null", "1:a", "1", ":", "a1:b", "-1:a"]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    assert pairs.select(hashtree.row_digest(pairs, ["a", "b"])).distinct().count() == len(values) ** 2
    joined, split = (spark.createDataFrame([row], "a string, b string") for row in (("a\u001fb", "c"), ("a", "b\u001fc")))
    assert checksum(joined) != checksum(split)

    def nested(value, dtype):
        return checksum(spark.createDataFrame([(value,)], f"x {dtype}"))

    kinds = {"array<string>": [None, [], [None], [""], ["", ""], ["a", "b"], ["a,b"], ["b", "a"]],
             "map<string,int>": [None, {}, {"a": None}, {"a": 1}, {"a": 1, "b": 2}, {"b": 1, "a": 2}],
             "struct<a:string,b:string>": [None, (None, None), ("a", None), (None, "a"), ("a", "b")],
             "array<array<int>>": [[[1], [2]], [[1, 2]], [[], [1, 2]], [[1, 2], []]],
             "binary": [None, b"", b"\xff", b"\xfe", b"\xff\xfe"],
             "double": [None, 0.0, 1.0, 1e300, float("nan"), float("inf")]}
    for dtype, cases in kinds.items():
        assert len({nested(v, dtype) for v in cases}) == len(cases), dtype
    assert nested({"a": 1, "b": 2}, "map<string,int>") == nested({"b": 2, "a": 1}, "map<string,int>")
    assert nested(0.0, "double") == nested(-0.0, "double")


def test_checksum_of_tables(spark):
    frame = spark.range(500).select("id", F.concat(F.lit("v"), "id").alias("v"))
    assert checksum(frame) == checksum(frame.orderBy(F.desc("id")).repartition(7))
    assert checksum(frame) != checksum(frame.unionByName(frame.limit(1))) != checksum(frame.filter("id > 0"))
    assert checksum(frame.limit(0)) == (0, "0-0-0-0")


def table(spark, n=4000):
    return spark.range(n).select((F.col("id") - 5).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") * 1.5).alias("v"),
                                 F.expr("map('a', id, 'b', id % 3)").alias("m"), F.expr("IF(id % 50 = 0, null, id % 4)").alias("part"))


@pytest.mark.parametrize("keys", [["k"], ["k", "part"]])
def test_differences_by_tree(spark, keys):
    first = table(spark)
    second = first.filter("k <> 77 AND k <> 78").withColumn(
        "v", F.expr("IF(k = 3000, v + 1, IF(k = 100, null, v))")).withColumn(
        "m", F.expr("IF(k = 200, map('a', 1L, 'c', 2L), IF(k = 201, map('b', (k + 5) % 3, 'a', k + 5), m))"))
    second = second.unionByName(first.filter("k = 9").withColumn("k", F.lit(99999).cast("long")))
    by_rows = consistency.differences(first, second, keys)
    by_tree = consistency.differences(first, second, keys, by_tree=True)
    out = ["k", "status"]
    assert rows(by_tree, *out) == rows(by_rows, *out) == [
        (100, "different"), (200, "different"), (3000, "different"), (77, "missing"), (78, "missing")]
    assert consistency.differences(first, first, keys, by_tree=True).count() == 0
    assert consistency.differences(first, first.limit(0), keys, by_tree=True).count() == 4000
    assert consistency.differences(first.limit(0), first, keys, by_tree=True).count() == 0


def test_repeated_and_null_keys_by_tree(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "x"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (None, "y"), (2, "c"), (2, "c")], "k int, v string")
    assert rows(consistency.differences(left, right, ["k"], by_tree=True)) == rows(consistency.differences(left, right, ["k"])) \
        == [(None, "x", "different")]
    with pytest.raises(ValueError, match="different types"):
        consistency.differences(left, right.withColumn("v", F.lit(1)), ["k"], by_tree=True)


def test_tree_adds_up_and_finds_leaves(spark):
    frame = table(spark).drop("m")
    tree = hashtree.build(frame, ["k"], bits=8)
    levels = {r.level: (r.n, r.a, r.b) for r in tree.groupBy("level").agg(
        F.sum("n").alias("n"), F.sum("s0").alias("a"), F.sum("s1").alias("b")).collect()}
    assert set(levels) == {0, 1, 2} and len(set(levels.values())) == 1 and levels[0][0] == 4000
    other = hashtree.build(frame.withColumn("v", F.expr("IF(k IN (5, 6), 0, v)")), ["k"], bits=8)
    leaves, count, read = hashtree.differing(tree, other)
    wanted = {r.b for r in frame.filter("k IN (5, 6)").select(hashtree.bucket(frame, ["k"], 8).alias("b")).collect()}
    assert {r.node for r in leaves.collect()} == wanted and count == len(wanted) and read == 3
    assert hashtree.differing(tree, tree)[1:] == (0, 1)  # told at the root
    with pytest.raises(ValueError, match="levels"):
        hashtree.differing(tree, hashtree.build(frame, ["k"], bits=4))


def test_few_changes_shuffle_few_rows(spark):
    """Of 0.1 % changed rows, the rows that reach the comparison are a small part of either table."""
    first = table(spark, 20_000)
    second = first.withColumn("v", F.expr("IF(k % 1000 = 0, -1.0, v)"))
    left, right = hashtree.changed_rows(first, second, ["k"], first.columns)
    assert 20 <= left.count() == right.count() < 0.12 * 20_000
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning", plan)
    assert rows(consistency.differences(first, second, ["k"], by_tree=True), "k") == rows(
        consistency.differences(first, second, ["k"]), "k")


def test_maps_in_compared_columns(spark):
    """Differences, upsert and change logs of tables with map columns; the last of repeated rows; maps come along."""
    old = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"a": 1}), (3, None)], "k int, m map<string,int>")
    new = spark.createDataFrame([(1, {"b": 2, "a": 1}), (2, {"a": 2}), (4, {"z": 0}), (4, {"y": 0})], "k int, m map<string,int>")
    assert [(r.k, r.m, r.status) for r in consistency.differences(new, old, ["k"]).orderBy("k").collect()] == [
        (2, {"a": 2}, "different"), (4, {"z": 0}, "missing")]
    assert tuple(consistency.metrics(new, old, ["k"]).first()) == (1, 1, 3)
    level = {r.k: r.m for r in consistency.upsert(new, old, ["k"]).collect()}
    assert level == {1: {"a": 1, "b": 2}, 2: {"a": 2}, 3: None, 4: {"z": 0}}
    log = changes.diff(old, new, ["k"], F.lit(1))
    assert {(r.k, r.op) for r in log.collect()} == {(2, "update"), (3, "delete"), (4, "insert")}
    assert {r.k: r.m for r in changes.apply(old, log, ["k"]).collect()} == {1: {"a": 1, "b": 2}, 2: {"a": 2}, 4: {"z": 0}}
    by_map = consistency.upsert(new, old, ["k"], order_by=["m"])
    assert {r.k: r.m for r in by_map.collect()}[4] == {"z": 0}
