"""Column profiles, issues, anomalies and quality scores.

Scalar measures come from one aggregation over the table. Exact distinct counts and top values come from one melt
``(column, value)`` whose counts are combined before the shuffle, exact quantiles from a bracketed search;
``approx=True`` replaces them by sketches in the same single aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions.columns import TEMPORAL, NUMERIC, as_text, field, trimmed
from millrace.operators import skew
from millrace.operators.quality_rules import QualityRule, summary
from millrace.operators.windows import apply_window
from millrace.session import materialize

TOP_VALUES = 10
NULL_RATIO = 0.5
SIGMAS = 3.0


def _text(df: DataFrame, name: str) -> Column:
    return as_text(field(name), df.schema[name].dataType)


def _number(df: DataFrame, name: str) -> Column:
    numeric = isinstance(df.schema[name].dataType, NUMERIC)
    return field(name).cast("double") if numeric else F.lit(None).cast("double")


def _stack(df: DataFrame, columns: list[str], row) -> DataFrame:
    """One aggregation, one output row per column; ``row(name)`` lists aliased aggregates."""
    return df.agg(_described(columns, row).alias("rows")).select(F.inline("rows"))


def _described(columns: list[str], row) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column"), *row(c)) for c in columns])


def _listed(df: DataFrame, columns: list[str], rows: list, row) -> DataFrame:
    """The rows of a :func:`_described` aggregate that has been read: one per column."""
    schema = df.agg(_described(columns, row).alias("rows")).schema["rows"].dataType.elementType
    return df.sparkSession.createDataFrame(rows, schema)


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, row_count, null_count, empty_count (text that trims to nothing)."""
    return _stack(df, columns or df.columns, lambda c: [
        F.count(F.lit(1)).alias("row_count"), F.count_if(field(c).isNull()).alias("null_count"),
        F.count_if(trimmed(_text(df, c)) == "").alias("empty_count")])


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (text), number (for numeric columns), n: one row per distinct non-null value.

    Integers and doubles are counted as numbers and printed afterwards, once per distinct value.
    """
    columns = columns or df.columns
    as_number = (T.ByteType, T.ShortType, T.IntegerType, T.DoubleType)

    def cell(i: int, name: str) -> Column:
        exact = isinstance(df.schema[name].dataType, as_number)
        return F.struct(F.lit(i).alias("i"), (F.lit(None).cast("string") if exact else _text(df, name)).alias("text"),
                        _number(df, name).alias("number"))

    melted = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))) \
        .filter(F.col("text").isNotNull() | F.col("number").isNotNull())
    counted = melted.groupBy("i", "text", "number").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return counted.select(
        F.get(names, F.col("i")).alias("column"),
        F.coalesce("text", as_text(F.col("number"), T.DoubleType())).alias("value"), "number", "n")


def unique_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """column, unique_count (of non-null values); values meet by 128-bit hashes, so long text is not shuffled."""
    columns = columns or df.columns
    if approx:
        return _stack(df, columns, lambda c: [F.approx_count_distinct(_text(df, c) if "map<" in df.schema[c].dataType.simpleString()
                                                                      else field(c)).alias("unique_count")])

    def cell(i: int, name: str) -> Column:
        value, dtype = field(name), df.schema[name].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)
        elif not isinstance(dtype, NUMERIC + TEMPORAL + (T.StringType, T.BooleanType, T.BinaryType)):
            value = _text(df, name)
        hashes = [F.xxhash64(F.lit(seed), value).alias(n) for seed, n in ((0, "a"), (1, "b"))]
        return F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), *hashes))

    cells = F.array(*[cell(i, c) for i, c in enumerate(columns)])
    found = df.select(F.inline(cells)).filter("i IS NOT NULL").groupBy("i", "a", "b").agg(F.lit(1).alias("one")).groupBy("i") \
        .agg(F.count(F.lit(1)).alias("unique_count"))
    named = found.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), "unique_count")
    return _with_all(df, columns, named, {"unique_count": F.lit(0).cast("bigint")})


def _unique_of(values: DataFrame) -> DataFrame:
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))


def _with_all(df: DataFrame, columns: list[str], found: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Keep a row for columns that had no values at all (a list of column names, so tiny)."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    joined = F.broadcast(names).join(found, "column", "left")
    return joined.select("column", *[F.coalesce(F.col(k), v).alias(k) for k, v in defaults.items()])


def top_values(values: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """column, place, value, n: the k most frequent values of each column, ties by value.

    ``values`` is the output of :func:`value_counts`. Spark limits each task to k rows per column before the
    shuffle, so a column with many values does not gather in one task.
    """
    ranked = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return values.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k) \
        .select("column", "place", "value", "n")


def quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float],
              max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Exact interpolated quantiles of the numeric columns: column and one output per named probability.

    A sketch gives a narrow bracket of values around each quantile; the values below it are counted, and only
    the values inside it are shuffled. The counts prove that the bracket holds the wanted ranks; one that did not
    would be opened to the whole column, so the answer is exact whatever the sketch says.
    """
    return _quantiles(df, columns, probabilities, max_group_rows)[0]


def _quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float], max_group_rows: int = skew.MAX_GROUP_ROWS,
               values: DataFrame | None = None, also: Column | None = None) -> tuple[DataFrame, object]:
    """Quantiles, and the value of ``also``, an aggregate over ``df`` that shares the sketch's pass.

    ``values``, the written output of :func:`value_counts`, is counted and searched in place of ``df``.
    """
    columns = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    spark = df.sparkSession
    if not columns:
        shared = df.agg(also.alias("also")).first()["also"] if also is not None else None
        return spark.createDataFrame([], "column string, " + ", ".join(f"{n} double" for n in probabilities)), shared
    targets = [(i, j, p) for i in range(len(columns)) for j, p in enumerate(probabilities.values())]
    sketched, shared = _sketch(df, columns, targets, also)
    brackets, totals = _brackets(df if values is None else values, columns, targets, sketched, values is not None)

    def number(i: int) -> Column:
        return _number(df, columns[i]) if values is None else F.when(F.col("column") == columns[i], F.col("number"))

    def inside(i: int, j: int) -> Column:
        low, high = brackets[i, j]
        test = number(i).isNotNull()
        return test if low is None else test & (number(i) >= low) & (number(i) <= high)

    weight = F.lit(1).cast("bigint") if values is None else F.col("n")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(inside(i, j), number(i)).alias("x"),
                               weight.alias("w")) for i, j, _ in targets])
    counted = (df if values is None else values).select(F.inline(cells)).filter("x IS NOT NULL") \
        .groupBy("i", "j", "x").agg(F.sum("w").alias("n"))
    # the bracket sizes are known, so large ones are looked for only when there are any
    largest = max(size for _, _, size in totals.values())
    running = apply_window(counted, "Sum", ["i", "j"], ["x"], "upto", "n", max_group_rows=max_group_rows,
                           heavy=None if largest > max_group_rows else skew.NONE)
    ranks = []
    for i, j, p in targets:
        n, below, _ = totals[i, j]
        position = p * max(n - 1, 0)
        ranks.append((i, j, int(position) - below, -int(-position // 1) - below, position - int(position)))
    wanted = spark.createDataFrame(ranks, "i int, j int, lo bigint, hi bigint, part double")  # columns x quantiles rows

    def at(rank: str) -> Column:
        # smallest value with more than `rank` bracket values at or below it
        return F.min(F.when(F.col("upto") > F.col(rank), F.col("x")))

    found = running.join(F.broadcast(wanted), ["i", "j"]).groupBy("i", "j").agg(
        at("lo").alias("a"), at("hi").alias("b"), F.first("part").alias("part"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    wide = found.groupBy("i").agg(*[F.max(F.when(F.col("j") == j, value)).alias(name)
                                    for j, name in enumerate(probabilities)])
    return wide.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), *probabilities), shared


_ACCURACY = 2_000


def _sketch(df: DataFrame, columns: list[str], targets: list[tuple[int, int, float]], also: Column | None) -> tuple[dict, object]:
    """(bracket per target, the value of ``also``) in one aggregation."""
    slack = 4 / _ACCURACY
    wanted: dict[int, list[tuple[int, float]]] = {}
    for i, j, p in targets:
        wanted.setdefault(i, []).append((j, p))
    sketch = df.agg(*[
        F.percentile_approx(_number(df, columns[i]), F.array(*[
            F.lit(min(max(p + d, 0.0), 1.0)) for _, p in ps for d in (-slack, slack)]), _ACCURACY).alias(f"q{i}")
        for i, ps in wanted.items()], (F.lit(None) if also is None else also).alias("also")).first()  # one sketch per column
    brackets = {(i, j): tuple(sketch[f"q{i}"][2 * k:2 * k + 2]) if sketch[f"q{i}"] else (None, None)
                for i, ps in wanted.items() for k, (j, _) in enumerate(ps)}
    return brackets, sketch["also"]


def _brackets(rows: DataFrame, columns: list[str], targets: list[tuple[int, int, float]], brackets: dict,
              weighted: bool) -> tuple[dict, dict]:
    """(bracket per target, (column values, values below the bracket, values in it) per target) in one aggregation."""
    brackets, measures = dict(brackets), []

    def counted(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)) if weighted else F.count_if(test)

    for i, j, _ in targets:
        x = F.when(F.col("column") == columns[i], F.col("number")) if weighted else _number(rows, columns[i])
        low, high = brackets[i, j]
        measures += [counted(x.isNotNull()).alias(f"n{i}_{j}"),
                     (F.lit(0) if low is None else counted(x < low)).alias(f"b{i}_{j}"),
                     counted(x.isNotNull() if low is None else x <= high).alias(f"u{i}_{j}")]
    counts_of = rows.agg(*measures).first()
    totals = {}
    for i, j, p in targets:
        n, below, upto = counts_of[f"n{i}_{j}"], counts_of[f"b{i}_{j}"], counts_of[f"u{i}_{j}"]
        position = p * max(n - 1, 0)
        if not below <= int(position) or not -int(-position // 1) < upto:
            brackets[i, j], below, upto = (None, None), 0, n
        totals[i, j] = (n, below, upto - below)
    return brackets, totals


def min_max(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """column, min, max, avg, median, all as text; avg and median only for numeric columns."""
    columns = columns or df.columns
    if approx:
        return _stack(df, columns, lambda c: _extremes(df, c, approx))
    medians, rows = _quantiles(df, columns, {"q": 0.5}, also=_described(columns, lambda c: _extremes(df, c, approx)))
    joined = _listed(df, columns, rows, lambda c: _extremes(df, c, approx)).join(F.broadcast(medians), "column", "left")
    return joined.select("column", "min", "max", "avg", F.col("q").cast("string").alias("median"))


def _extremes(df: DataFrame, name: str, approx: bool) -> list[Column]:
    dtype = df.schema[name].dataType
    number = _number(df, name)
    ordered = "map<" not in dtype.simpleString()  # maps have no order
    found = [(as_text(f(field(name)), dtype) if ordered else F.lit(None).cast("string")).alias(n)
             for f, n in ((F.min, "min"), (F.max, "max"))] + [
        F.avg(number).cast("string").alias("avg")]
    return found + [F.percentile_approx(number, 0.5).cast("string").alias("median")] if approx else found


def _moments(df: DataFrame, name: str) -> list[Column]:
    number = _number(df, name)
    return [F.avg(number).alias("mean"), F.stddev(number).alias("stddev"), F.variance(number).alias("variance"),
            F.skewness(number).alias("skewness"), F.kurtosis(number).alias("kurtosis")]


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, mean, stddev, variance, skewness, kurtosis, p25, p75 of the numeric columns."""
    columns = [c for c in columns or df.columns if isinstance(df.schema[c].dataType, NUMERIC)]
    quarters, rows = _quantiles(df, columns, {"p25": 0.25, "p75": 0.75}, also=_described(columns, lambda c: _moments(df, c)))
    return _listed(df, columns, rows, lambda c: _moments(df, c)).join(F.broadcast(quarters), "column", "left")


def profile(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES, approx: bool = False) -> DataFrame:
    """The full profile, one row per column.

    The exact form reads the rows twice: for the value counts, written to the shared folder once because several
    measures read them, and for all other aggregates together.
    """
    columns = columns or df.columns

    def scalars(c: str) -> list[Column]:
        return [F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("row_count"), F.count_if(field(c).isNull()).alias("null_count"),
                F.count_if(trimmed(_text(df, c)) == "").alias("empty_count"),
                *_extremes(df, c, approx), *_moments(df, c)]

    def sketches(c: str) -> list[Column]:
        number = _number(df, c)
        top = F.call_function("approx_top_k", _text(df, c), F.lit(k), F.lit(max(1000, 8 * k)))
        return [F.approx_count_distinct(field(c)).alias("unique_count"),
                F.percentile_approx(number, 0.25).alias("p25"), F.percentile_approx(number, 0.75).alias("p75"),
                F.map_from_entries(F.transform(F.filter(top, lambda e: e["item"].isNotNull()),
                                               lambda e: F.struct(e["item"], e["count"]))).alias("top_values")]

    if approx:
        whole = _stack(df, columns, lambda c: scalars(c) + sketches(c))
    else:
        values = materialize(value_counts(df, columns))
        top = top_values(values, k).groupBy("column").agg(
            F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))),
                                           lambda e: F.struct(e["value"], e["n"]))).alias("top_values"))
        quarters, rows = _quantiles(df, columns, {"p25": 0.25, "q": 0.5, "p75": 0.75}, values=values,
                                    also=_described(columns, scalars))
        whole = _listed(df, columns, rows, scalars)
        # each right side has one row per column
        for part in (_unique_of(values), top, quarters):
            whole = whole.join(F.broadcast(part), "column", "left")
        whole = whole.withColumn("median", F.col("q").cast("string"))
    numbers = ("stddev", "variance", "skewness", "kurtosis", "p25", "p75")
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in numbers])
    stats = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return whole.select(
        "column", "type", "row_count", "null_count", "empty_count",
        F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"), "min", "max", "avg", "median",
        "mean", "stddev", "top_values", stats.alias("statistics"))


def _outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, outliers: values more than three deviations from the mean."""
    limits = df.agg(*[a for i, c in enumerate(columns) for a in
                      (F.avg(_number(df, c)).alias(f"__m{i}"), F.stddev(_number(df, c)).alias(f"__s{i}"))])
    both = df.crossJoin(F.broadcast(limits))  # exactly one row
    return _stack(both, columns, lambda c: [F.count_if(
        F.abs(_number(df, c) - F.col(f"__m{columns.index(c)}")) > SIGMAS * F.col(f"__s{columns.index(c)}")
    ).alias("outliers")])


def issues(df: DataFrame, profiled: DataFrame, key_columns: list[str] | None = None) -> DataFrame:
    """column, issue, severity, confidence derived from the profile and one pass for outliers."""
    non_null = F.col("row_count") - F.col("null_count")
    ratio = F.try_divide(F.col("null_count"), F.col("row_count"))
    repeated = F.lit(1.0) - F.try_divide(F.col("unique_count"), non_null)
    numeric = [c for c in df.columns if isinstance(df.schema[c].dataType, NUMERIC)]

    def issue(test: Column, name: str, severity: str, confidence: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"),
                                     confidence.cast("double").alias("confidence")))

    found = [
        issue(ratio > NULL_RATIO, "HighNullRatio", "Warning", ratio),
        issue((F.col("unique_count") == 1) & (F.col("null_count") == 0), "ConstantColumn", "Info", F.lit(1.0)),
    ]
    if key_columns:
        found.append(issue(F.col("column").isin(key_columns) & (repeated > 0), "DuplicateKey", "Error", repeated))
    joined = profiled
    if numeric:
        joined = profiled.join(F.broadcast(_outlier_counts(df, numeric)), "column", "left")
        found.append(issue(F.col("outliers") > 0, "Outliers", "Warning", F.try_divide("outliers", non_null)))
    return joined.select("column", F.inline(F.filter(F.array(*found), lambda i: i.isNotNull())))


def anomalies(df: DataFrame, profiled: DataFrame, columns: list[str] | None = None,
              target: str = "anomalies") -> DataFrame:
    """Rows with ``array<struct<column,anomaly>>`` measured against a profile of earlier data."""
    columns = columns or df.columns
    known = profiled.filter(F.col("column").isin(columns)).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("column"), F.struct("row_count", "null_count", "unique_count", "min", "max", "mean", "stddev",
                                  "top_values")))).alias("__profile"))  # one row, one entry per column
    found = []
    for name in columns:
        p = F.element_at("__profile", F.lit(name))
        number, text = _number(df, name), _text(df, name)
        numeric = isinstance(df.schema[name].dataType, NUMERIC)
        low, high = (p["min"].try_cast("double"), p["max"].try_cast("double")) if numeric else (p["min"], p["max"])
        value = number if numeric else text
        complete = (p["unique_count"] <= F.size(p["top_values"])) & (p["unique_count"] > 0)
        tests = {
            "UnexpectedNull": field(name).isNull() & (p["null_count"] == 0) & (p["row_count"] > 0),
            "OutOfRange": (value < low) | (value > high),
            "UnknownValue": complete & ~F.array_contains(F.map_keys(p["top_values"]), text),
        }
        if numeric:
            tests["Outlier"] = F.abs(number - p["mean"]) > SIGMAS * p["stddev"]
        found += [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(name).alias("column"), F.lit(a).alias("anomaly")))
                  for a, t in tests.items()]
    listed = F.filter(F.array(*found), lambda a: a.isNotNull())
    return df.crossJoin(F.broadcast(known)).select(*[field(c) for c in df.columns], listed.alias(target))


def scores(df: DataFrame, profiled: DataFrame | None = None, rules: list[QualityRule] | None = None) -> DataFrame:
    """metric, score: completeness, uniqueness, validity (when rules are given) and their mean as overall.

    Without a profile only the counts that the scores need are taken."""
    if profiled is None:
        profiled = counts(df).join(F.broadcast(unique_counts(df)), "column")  # a row per column
    totals = profiled.agg(
        (F.lit(1.0) - F.try_divide(F.sum("null_count"), F.sum("row_count"))).alias("completeness"),
        F.avg(F.try_divide(F.col("unique_count"), F.col("row_count") - F.col("null_count"))).alias("uniqueness"))
    names = ["completeness", "uniqueness"]
    if rules:
        passed = summary(df, rules).agg(F.try_divide(F.sum("passed"), F.sum(F.col("passed") + F.col("failed")))
                                        .alias("validity"))
        totals = totals.crossJoin(F.broadcast(passed))  # one row each
        names.append("validity")
    overall = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0.0)))
    listed = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names],
                     F.struct(F.lit("overall").alias("metric"), (overall / len(names)).alias("score")))
    return totals.select(F.inline(listed))


def report(df: DataFrame, rules: list[QualityRule] | None = None, key_columns: list[str] | None = None,
           columns: list[str] | None = None) -> DataFrame:
    """section, column, metric, value (text): profile, issues and scores in one long table."""
    columns = columns or df.columns
    profiled = materialize(profile(df, columns))  # a few rows per column, read three times
    measures = ("row_count", "null_count", "empty_count", "unique_count", "min", "max", "avg", "median")
    lines = profiled.select("column", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in measures])))
    found = issues(df.select(*[field(c) for c in columns]), profiled, key_columns)
    rated = scores(df, profiled, rules)
    return (
        lines.select(F.lit("profile").alias("section"), "column", "metric", "value")
        .unionByName(found.select(F.lit("issue").alias("section"), "column", F.col("issue").alias("metric"),
                                  F.col("severity").alias("value")))
        .unionByName(rated.select(F.lit("score").alias("section"), F.lit(None).cast("string").alias("column"), "metric",
                                  F.col("score").cast("string").alias("value")))
    )
