"""Folds over ordered groups and linear models, against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import table_functions as tf
from tests.conftest import rows

START = datetime(2024, 3, 30)


def plain_sessions(events, idle, longest):
    """(key, id) → start of its session; ``events`` are (key, id, time)."""
    out, state = {}, {}
    for key, number, time in sorted((e for e in events if e[2]), key=lambda e: e[2]):
        start, last = state.get(key, (None, None))
        if start is None or (time - last).total_seconds() > idle or (time - start).total_seconds() > longest:
            start = time
        state[key] = (start, time)
        out[number] = start
    return out | {e[1]: None for e in events if not e[2]}


@pytest.fixture(scope="module")
def events():
    draw = random.Random(11)
    found = [(draw.choice([1, 1, 1, 2, 3, None]), i, START + timedelta(seconds=draw.randint(0, 90_000), microseconds=draw.choice([0, 1])))
             for i in range(600)]
    return found + [(1, 1_000, None), (9, 1_001, None), (2, 1_002, found[0][2]), (2, 1_003, found[0][2])]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("max_group_rows", [10, 1_000_000])
def test_sessions(spark, events, kind, max_group_rows):
    df = spark.createDataFrame(events, f"`a user` int, id int, `t.s` {kind}")
    for idle, longest in ((300, 900), (1e9, 3_600), (120.5, 1e9)):
        out = tf.sessions(df, ["a user"], "t.s", idle, longest, max_group_rows=max_group_rows)
        assert out.columns == ["a user", "id", "t.s", "session_start"] and out.schema["session_start"].dataType == df.schema["t.s"].dataType
        assert {r["id"]: r["session_start"] for r in out.collect()} == plain_sessions(events, idle, longest)


def test_a_large_group_is_cut_into_pieces_for_many_tasks(spark):
    """One user holds nearly all rows; the pauses spread them."""
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("user"),
                                    F.timestamp_seconds(F.col("id") * 2 + F.floor(F.col("id") / 100) * 1_000).alias("ts"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tf.sessions(df, ["user"], "ts", 500, 60, max_group_rows=1_000)
        held = [r["n"] for r in out.filter("user = -1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) == 8 and max(held) < 0.3 * sum(held) and sum(held) == 20_000 - 400


def test_folds(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("b", 1, 1.0), (None, 1, 7.0), (None, 2, None)], "k string, i int, v double")

    def running_maximum():
        best = None

        def step(row):
            nonlocal best
            best = row["v"] if best is None else max(best, row["v"] or best)
            return best, row["i"]

        return step

    out = tf.fold_groups(df, ["k"], ["i"], running_maximum, "best double, seen int")
    assert rows(out) == [(None, 1, 7.0, 7.0, 1), (None, 2, None, 7.0, 2), ("a", 1, 3.0, 3.0, 1), ("a", 2, 5.0, 5.0, 2), ("b", 1, 1.0, 1.0, 1)]
    whole = tf.fold_groups(df.filter("v > 0"), [], ["v"], running_maximum, "best double, seen int")
    assert sorted(r["best"] for r in whole.collect()) == [1.0, 3.0, 5.0, 7.0]
    assert tf.fold_groups(df.limit(0), ["k"], ["i"], running_maximum, "best double, seen int").collect() == []
    with pytest.raises(ValueError, match="columns of the input"):
        tf.fold_groups(df, ["k"], ["i"], running_maximum, "v double")
    with pytest.raises(ValueError, match="order fields"):
        tf.fold_groups(df, ["k"], [], running_maximum, "w double")


def test_linear_models(spark):
    draw = np.random.default_rng(2)
    data, expected = [], {}
    for key in ("a", "b", None):
        x = draw.normal(size=(200, 2)) * [1.0, 1e4] + [5.0, 1e6]
        y = x @ [2.0, -0.01] + 3.0 + draw.normal(size=200)
        expected[key] = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
        data += [(key, *map(float, row), float(v)) for row, v in zip(x, y)]
    broken = [("a", None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0), ("b", 1.0, float("inf"), 1.0)]
    singular = [("s", float(i), 2.0 * i, 1.0) for i in range(5)] + [("one", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data + broken + singular, "k string, `x.1` double, x2 double, y double")
    models = tf.linear_models(df, ["k"], "y", ["x.1", "x2"])
    assert models.columns == ["k", "n", "intercept", "r2", "coef_x.1", "coef_x2"]
    found = {r["k"]: tuple(r)[1:] for r in models.collect()}
    for key, weights in expected.items():
        assert found[key][0] == 200 and 0 < found[key][2] < 1
        assert np.allclose([found[key][1], *found[key][3:]], weights, rtol=1e-6)
    assert found["s"] == (5, None, None, None, None) and found["one"] == (1, None, None, None, None)
    scored = tf.apply_linear_models(df, models, ["k"], ["x.1", "x2"], "guess", max_group_rows=50)
    for r in scored.filter("k = 'a' and `x.1` < 100").collect():
        assert r["guess"] == pytest.approx(expected["a"] @ [1.0, r["x.1"], r["x2"]])
    assert scored.count() == df.count() and scored.filter("k = 's' and guess is not null").isEmpty()
    assert tf.linear_models(df.limit(0), [], "y", ["x2"]).collect() == []
    whole = tf.linear_models(df.filter("k = 's'"), [], "x2", ["x.1"])
    assert tuple(whole.first()) == pytest.approx((5, 0.0, 1.0, 2.0), abs=1e-9)
    assert tf.apply_linear_models(df.filter("k = 's'"), whole, [], ["x.1"], "y").filter("abs(y - x2) > 1e-9").isEmpty()
