"""Tables copied at the same time."""

import threading
import time

import pytest

from millrace.operators import replication
from tests.conftest import rows


def test_loads_overlap_and_stay_within_the_bound(spark):
    sources = {f"t{i}": spark.range(i + 1) for i in range(6)}
    running, most, lock = [], [], threading.Lock()

    def load(name, df):
        with lock:
            running.append(name)
            most.append(len(running))
        n = df.count()
        time.sleep(0.5)
        with lock:
            running.remove(name)
        if name == "t2":
            raise RuntimeError("no such place")
        return n

    out = replication.all_tables(spark, sources, load, ["T5"], at_once=3)
    assert [tuple(r) for r in out.collect()] == [("t0", 1), ("t1", 2), ("t2", -1), ("t3", 4), ("t4", 5)]
    assert max(most) == 3


def test_local_properties_are_the_callers_and_pools_the_tables(spark):
    context, seen = spark.sparkContext, {}
    context.setLocalProperty("millrace.test", "mine")
    context.setLocalProperty("spark.scheduler.pool", "outer")
    try:
        def load(name, df):
            seen[name] = (context.getLocalProperty("millrace.test"), context.getLocalProperty("spark.scheduler.pool"))
            return df.count()
        replication.all_tables(spark, {n: spark.range(1) for n in "abc"}, load, at_once=2)
        assert seen == {n: ("mine", f"replicate-{n}") for n in "abc"}
        assert context.getLocalProperty("spark.scheduler.pool") == "outer"
    finally:
        context.setLocalProperty("millrace.test", None)
        context.setLocalProperty("spark.scheduler.pool", None)


def test_no_tables_and_bad_bounds(spark):
    assert rows(replication.all_tables(spark, {}, lambda n, d: 0)) == []
    with pytest.raises(ValueError, match="at least one"):
        replication.all_tables(spark, {}, lambda n, d: 0, at_once=0)
