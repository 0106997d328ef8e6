"""Aggregates, reshaping, paging, consistency, change capture, lineage, run history, masking, enrichment."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, consistency, enrichment, joins, lineage, masking, paging, replication, reshape, runs
from millrace.operators.aggregates import Agg, Measure, aggregate, summarize
from millrace.operators.joins import On, apply_join
from millrace.operators.masking import Mask
from tests.conftest import rows


# -- aggregates -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [("a_b", "c", "1.5"), ("a", "b_c", "2"), ("a", "b_c", "x"), (None, "z", "n/a"), (None, "z", None)],
        "g string, h string, v string")


def test_summarize_ignores_what_is_not_a_number(mixed):
    out = summarize(mixed, ["g", "h"], [Measure("v", f, f) for f in ("sum", "count", "avg", "median")] + [Measure("", "sum")])
    found = {(r["g"], r["h"]): (r["sum"] and float(r["sum"]), r["count"], r["median"]) for r in out.collect()}
    assert found == {("a_b", "c"): (1.5, 1, 0), ("a", "b_c"): (2.0, 1, 0), (None, "z"): (None, 0, None)}


def test_default_output_name(mixed):
    assert summarize(mixed, ["g"], [Measure("v", "Sum")]).columns == ["g", "Sum_v"]


def test_global_aggregate_of_nothing_is_no_row(mixed):
    assert summarize(mixed.limit(0), [], [Measure("v", "count")]).isEmpty()
    assert aggregate(mixed.limit(0), [], {"n": Agg("Count")}).isEmpty()
    assert aggregate(mixed, [], {"n": Agg("Count")}).first()["n"] == 5


def test_first_and_last_need_an_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, None, 1), (1, "c", 3)], "k int, v string, o int")
    out = aggregate(df, ["k"], {"f": Agg("First", "v", order=("o",)), "l": Agg("Last", "v", order=("o",))}).first()
    assert (out["f"], out["l"]) == (None, "c")
    with pytest.raises(ValueError):
        aggregate(df, ["k"], {"f": Agg("First", "v")})


def test_pivot_then_unpivot_is_the_input(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7), (2, "b", None)], "id int, c string, v bigint")
    wide = reshape.pivot(df, ["id"], "c", "v", "Sum")
    assert wide.columns == ["id", "a", "b"]
    assert rows(reshape.unpivot(wide, ["id"], ["a", "b"], "c", "v")) == rows(df)


# -- joins and paging -------------------------------------------------------------------------------------------

def test_clashing_names_get_a_prefix(spark):
    left = spark.createDataFrame([(1, "x")], "id int, v string")
    right = spark.createDataFrame([(1, "y")], "id int, v string")
    assert apply_join(left, right, "Inner", [On("id", "id")]).first().asDict() == {
        "id": 1, "v": "x", "right_id": 1, "right_v": "y"}
    for how, on in (("Cross", []), ("Left", [On("id", "id", "LessThan")]), ("Inner", [On("id", "id", "NotEqual")])):
        with pytest.raises(ValueError):
            apply_join(left, right, how, on)
        assert apply_join(left, right, how, on, allow_cross=True).count() == (0 if how == "Inner" else 1)


@pytest.mark.parametrize("operator", ["LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"])
def test_inequality_join_equals_brute_force(spark, operator):
    left = spark.range(80).select(F.col("id").alias("a"), ((F.col("id") * 7) % 23).alias("x"))
    right = spark.range(60).select(F.col("id").alias("b"), ((F.col("id") * 5) % 29).alias("y"))
    test = {"LessThan": "x < y", "LessThanOrEqual": "x <= y", "GreaterThan": "x > y", "GreaterThanOrEqual": "x >= y"}[operator]
    with pytest.raises(ValueError):
        apply_join(left, right, "Inner", [On("x", "y", operator)])
    assert rows(apply_join(left, right, "Inner", [On("x", "y", operator)], allow_cross=True)) == rows(left.crossJoin(right).filter(test))
    split = joins.inequality_join(left, right, "x", "y", operator, task_rows=7)
    assert rows(split) == rows(left.crossJoin(right).filter(test))


_TYPES = [["tinyint", "bigint", "float", "double", "decimal(12,3)"], ["date", "timestamp", "timestamp_ntz"]]


@pytest.mark.parametrize("x,y", [(a, b) for kind in _TYPES for a in kind for b in kind])
def test_ordering_joins_over_all_pairs_of_types(spark, x, y):
    def value(dtype, n):
        return f"CAST({n} AS {dtype})" if dtype in _TYPES[0] else \
            f"CAST(timestampadd(HOUR, CAST({n} * 7 AS INT), timestamp_ntz'2020-01-01') AS {dtype})"

    left = spark.range(40).selectExpr("id AS a", f"{value(x, 'id % 23')} AS x")
    right = spark.range(30).selectExpr("id AS b", f"{value(y, '(id * 5) % 29')} AS y", f"{value(y, '(id * 5) % 29 + id % 4')} AS z")
    both = left.crossJoin(right)
    assert rows(joins.inequality_join(left, right, "x", "y", "GreaterThanOrEqual", task_rows=9), "a", "b") == rows(both.filter("x >= y"), "a", "b")
    assert rows(joins.range_join(left, right, "x", "y", "z", 1.0), "a", "b") == rows(both.filter("x BETWEEN y AND z"), "a", "b")


@pytest.mark.parametrize("width", [1.0, 4.0, 50.0])
def test_range_join_equals_brute_force(spark, width):
    points = spark.range(100).select((F.col("id") * 1.7 - 30).alias("p"))
    ranges = spark.range(40).select((F.col("id") * 3.1 - 40).alias("lo"), (F.col("id") * 3.1 - 40 + F.col("id") % 9 - 1).alias("hi"))
    expected = points.crossJoin(ranges).filter("p >= lo AND p <= hi")
    assert rows(joins.range_join(points, ranges, "p", "lo", "hi", width)) == rows(expected)


def test_keyset_pages_cover_the_table(spark):
    df, seen, cursor = spark.range(25), [], None
    while True:
        got = paging.page_after(df, "id", cursor, 10).collect()
        seen += [r["id"] for r in got]
        if not got[-1]["has_more"]:
            break
        cursor = got[-1]["id"]
    assert seen == list(range(25))


def test_page_size_limits(spark):
    assert paging.page(spark.range(500), [], "id", 1, 999).count() == 100
    assert paging.page(spark.range(500), [], "id").count() == 10
    assert paging.page_info(spark.range(25), 3, 10).first().asDict() == {
        "page_number": 3, "page_size": 10, "total_count": 25, "total_pages": 3, "has_previous": True, "has_next": False}


# -- consistency and change capture -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def versions(spark):
    schema = "k int, g string, v double"
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "n", 3.0), (4, "d", 4.0)], schema)
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 9.0), (5, "e", 5.0)], schema)
    return old, new


def test_metrics(versions):
    old, new = versions
    assert tuple(consistency.metrics(new, old, ["k"]).first()) == (1, 2, 4)
    assert tuple(consistency.metrics(new, old, ["k"], ["g"]).first()) == (1, 0, 4)
    assert consistency.is_consistent(old, old, ["k"]).first()["consistent"]
    with pytest.raises(ValueError):
        consistency.metrics(new, old, [])


def test_last_duplicate_wins(spark):
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, n int")
    target = spark.createDataFrame([(1, "new", 0)], "k int, v string, n int")
    assert tuple(consistency.metrics(source, target, ["k"], ["v"], ["n"]).first()) == (0, 0, 1)


def test_upsert_reaches_consistency_without_deleting(versions):
    old, new = versions
    merged = consistency.upsert(new, old, ["k"])
    assert consistency.is_consistent(new, merged, ["k"]).first()["consistent"]
    assert merged.filter("k = 4").count() == 1 and merged.count() == 5


def test_applying_a_diff_gives_the_new_version(versions):
    old, new = versions
    log = changes.diff(old, new, ["k"], F.current_timestamp())
    assert rows(changes.apply(old, log, ["k"])) == rows(new)
    assert rows(log, "op", "k") == [("delete", 4), ("insert", 5), ("update", None), ("update", 2)]
    assert tuple(changes.sync_counts(log, ["k"]).first()) == (1, 1, 1, 1)


def test_latest_change_wins_and_reapplying_changes_nothing(spark):
    schema = "op string, ts int, txn string, k int, after struct<k:int,v:string>"
    log = spark.createDataFrame([("insert", 1, "a", 1, (1, "x")), ("delete", 2, "a", 1, None), ("insert", 2, "b", 1, (1, "y"))], schema)
    target = spark.createDataFrame([(1, "w"), (2, "z")], "k int, v string")
    once = changes.apply(target, log, ["k"])
    assert rows(once) == [(1, "y"), (2, "z")]
    assert rows(changes.apply(once, log, ["k"])) == rows(once)


def test_checksum_ignores_order_and_partitioning_but_not_content(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("x")).alias("s"))
    base = consistency.checksum(df).first()
    assert consistency.checksum(df.orderBy(F.col("id").desc()).repartition(7)).first() == base
    assert consistency.checksum(df.withColumn("s", F.when(F.col("id") == 5, "y").otherwise(F.col("s")))).first() != base
    a = spark.createDataFrame([("ab", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "bc")], "x string, y string")
    assert consistency.checksum(a).first() != consistency.checksum(b).first()


def test_high_water_mark(spark):
    source = spark.createDataFrame([(1, 10), (2, 20), (2, 30)], "k int, LastModified int")
    assert replication.new_rows(source, source.limit(0)).count() == 3
    seen = source.filter("LastModified <= 10")
    assert rows(replication.by_high_water_mark(source, seen)) == rows(source)
    with pytest.raises(ValueError):
        replication.by_keys(source, seen, [])


def test_sync_marks(spark):
    log = spark.createDataFrame([(1,), (2,), (3,)], "ts int")
    marks = spark.createDataFrame([("t", 2), ("u", 9)], "table string, mark int")
    assert rows(changes.since_mark(log, marks, "t")) == [(3,)]
    assert changes.since_mark(log, marks, "new").count() == 3
    assert tuple(changes.sync_mark(log, "t").first()) == ("t", 3)


# -- lineage and run history ------------------------------------------------------------------------------------

def test_walk_ends_on_cycles_and_takes_the_shortest_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "source_table string, target_table string")
    root = spark.createDataFrame([("a",)], "table string")
    assert rows(lineage.downstream(edges, root, 9), "table", "depth") == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(lineage.upstream(edges, root, 1), "table") == [("c",)]
    assert lineage.downstream(edges, spark.createDataFrame([("zz",)], "table string"), 3).isEmpty()


def test_runs(spark):
    schema = "run_id int, pipeline_id int, status string, started_at timestamp, processed bigint, failed bigint"
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(1, 1, "Completed", at[0], 5, 0), (2, 1, "Failed", at[1], 3, 2), (3, 2, "Cancelled", at[2], 0, 0)], schema)
    assert tuple(runs.statistics(df).first()) == (3, 1, 1, 0, 1, 8, 2)
    assert rows(runs.latest(df), "pipeline_id", "run_id") == [(1, 2), (2, 3)]
    assert rows(runs.in_range(df, at[0], at[1]), "run_id") == [(1,), (2,)]
    assert rows(runs.in_range(df, now=F.lit(at[2])), "run_id") == [(2,), (3,)]
    assert runs.count(df, "failed > 0").first()["count"] == 1
    assert runs.exists(df, "failed > 9").first()["exists"] is False
    assert tuple(runs.statistics(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


# -- masking and enrichment -------------------------------------------------------------------------------------

@pytest.mark.parametrize("mask,value,expected", [
    (Mask("Redact"), "x", "[REDACTED]"), (Mask("PartialMask", {"start": 1, "end": 2}), "abcdef", "a***ef"),
    (Mask("PartialMask", {"start": 3, "end": 3}), "abcdef", "******"), (Mask("PartialMask", {"start": 2}), "abcd", "ab**"),
    (Mask("Custom", {"expression": "reverse(v)"}), "abc", "cba")])
def test_masks(spark, mask, value, expected):
    out = masking.mask_data(spark.createDataFrame([(value,), (None,)], "v string"), {"v": mask}).collect()
    assert [r["v"] for r in out] == [expected, None]


def test_masks_are_stable_and_keyed(spark):
    df = spark.createDataFrame([("Ann-42 é",), ("Ann-42 é",), ("Bob-17 ü",)], "v string")
    for kind in ("Tokenize", "Hash", "Randomize"):
        masked = [r["v"] for r in masking.mask_data(df, {"v": Mask(kind, {"salt": "s"})}).collect()]
        again = [r["v"] for r in masking.mask_data(df.repartition(3), {"v": Mask(kind, {"salt": "s"})}).collect()]
        other = [r["v"] for r in masking.mask_data(df, {"v": Mask(kind, {"salt": "t"})}).collect()]
        assert masked[0] == masked[1] != masked[2] and sorted(masked) == sorted(again) and masked != other


def test_tokens_keep_the_shape(spark):
    token = masking.mask_data(spark.createDataFrame([("Ann-42",)], "v string"), {"v": Mask("Tokenize", {"salt": "s"})}).first()["v"]
    assert len(token) == 6 and token[0].isupper() and token[1:3].islower() and token[3] == "-" and token[4:].isdigit()


def test_date_shift_and_variance_stay_in_bounds(spark):
    df = spark.range(300).select("id", F.expr("DATE'2024-01-10'").alias("d"), F.lit(100.0).alias("v"), F.lit("e1").alias("e"))
    out = masking.mask_data(df, {"d": Mask("DateShift", {"salt": "s", "min": -30, "max": 30, "preserveDay": True, "key": "id"}),
                                 "v": Mask("NumberVariance", {"salt": "s", "min": -5, "max": 5})})
    bounds = out.agg(F.min("d"), F.max("d"), F.max(F.abs(F.datediff("d", F.lit("2024-01-10")) % 7)), F.min("v"), F.max("v")).first()
    assert bounds[0] >= dt.date(2023, 12, 11) and bounds[1] <= dt.date(2024, 2, 9) and bounds[2] == 0
    assert 95 <= bounds[3] <= bounds[4] <= 105


def test_detection(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org now"), (2, "card 4111 1111 1111 1111"), (3, "card 4111 1111 1111 1112"),
                                (4, "ssn 123-45-6789"), (5, "ip 10.0.0.1"), (6, "ip 999.0.0.1"), (7, None)], "id int, note string")
    out = masking.detect(df, columns=["note"]).select("id", F.inline("sensitive"))
    assert rows(out) == [(1, "note", "EmailAddress"), (2, "note", "CreditCardNumber"), (4, "note", "SocialSecurityNumber"),
                         (5, "note", "IpAddress")]
    assert masking.name_hints("customer_name") == ["PersonName"] and masking.name_hints("passwd") == ["Password"]


def test_calculated_fields(spark):
    df = spark.createDataFrame([(1, None, dt.date(2024, 1, 3), dt.date(2024, 1, 1))], "a int, b int, x date, y date")

    def value(kind, **spec):
        return enrichment.enrich_calculated(df, "t", kind, **spec).first()["t"]

    assert value("Sum", fields=["a", "b"]) == 1 and value("Average", fields=["a", "b"]) == 1.0
    assert value("Average", fields=["b"]) is None and value("Concatenate", fields=["a", "b"]) == "1"
    assert value("DateDiff", fields=["x", "y"]) == 2 and value("DateDiff", fields=["x", "y"], params={"unit": "hour"}) == 48
    assert value("Custom", expression="concat(:p, a::string)", params={"p": "it's "}) == "it's 1"


def test_sentiment_counts_whole_words(spark):
    df = spark.createDataFrame([(1, "Good, good; goodness!"), (2, "bad"), (3, None)], "id int, t string")
    out = enrichment.enrich_sentiment(df, "t", {"good": 1.0, "bad": -2.0})
    assert rows(out, "id", "sentiment_score", "sentiment_label") == [(1, 2.0, "positive"), (2, -2.0, "negative"), (3, 0.0, "neutral")]


def test_keyed_enrichment_calls_once_per_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    out = enrichment.enrich_by_key(df, "k", lambda b: b.assign(twice=b["k"] * 2), "k bigint, twice bigint")
    assert rows(out) == [(None, None), (1, 2), (1, 2), (2, 4)]


def test_pivot_takes_every_aggregate(spark):
    df = spark.createDataFrame([(1, "x", 5, 2), (1, "x", 6, 1), (1, "y", 7, 3)], "k int, c string, v int, o int")
    assert rows(reshape.pivot(df, ["k"], "c", "v", "First", order=["o"])) == [(1, 6, 7)]
    assert rows(reshape.pivot(df, ["k"], "c", "v", "Last", order=["o"])) == [(1, 5, 7)]
    assert rows(reshape.pivot(df, ["k"], "c", function="Custom", expression="sum(v * o)")) == [(1, 16, 21)]


def test_sentiment_with_a_long_lexicon(spark):
    lexicon = {f"word{i}": 1.0 for i in range(10_000)} | {"well-known": -4.0, "ünd": 2.0}
    df = spark.createDataFrame([("Word7 word9999, WORD10000 well-known Ünd",), (None,), ("",), ("swell-known",)], "t string")
    assert [r["sentiment_score"] for r in enrichment.enrich_sentiment(df, "t", lexicon).collect()] == [0.0, 0.0, 0.0, 0.0]
    assert enrichment.enrich_sentiment(df, "t", {"known": 1.5}).agg(F.sum("sentiment_score")).first()[0] == 3.0


def test_keyed_function_is_called_once_per_key(spark, tmp_path):
    df = spark.range(200).selectExpr("IF(id < 150, 1, id) AS k")

    def look_up(keys):
        for k in keys["k"]:
            with open(f"{tmp_path}/{k}", "a") as out:
                out.write("x")
        return keys.assign(v=keys["k"] * 2)

    found = enrichment.enrich_by_key(df, "k", look_up, "k bigint, v bigint", max_group_rows=20)
    assert found.filter("v = 2").count() == 150
    assert {(tmp_path / str(k)).read_text() for k in (1, 150, 199)} == {"x"}
    with pytest.raises(Exception, match="several rows"):
        enrichment.enrich_by_key(df, "k", lambda keys: pd.concat([keys, keys]), "k bigint").collect()


def test_tokenize_is_linear_in_the_length(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("ab1" * n,)], "t string")
        start = time.perf_counter()
        masking.mask_data(df, {"t": Mask("Tokenize", {"salt": "s"})}).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.3)
