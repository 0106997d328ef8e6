"""Exact quantiles and modes per group.

Groups of ordinary size use Spark's ``percentile``, which holds the distinct values of a group in one buffer. A group too
large for that is answered by brackets: a sketch per group puts two values around each wanted rank, the rows below and
inside are counted, and only the values inside are shuffled, by group, quantile and value. Counts prove each bracket; one
that fails is opened to its whole group. So the answer is exact, and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import all_of, field, numeric_value, same
from millrace.operators import skew
from millrace.operators.windows import apply_window
from millrace.session import materialize

ACCURACY = 2_000  # of the sketch; brackets are wider than its error


def grouped_quantiles(df: DataFrame, group_by: list[str], source: str, probabilities: dict[str, float],
                      max_group_rows: int = skew.MAX_GROUP_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """The group keys and one double per named probability, interpolated between neighbours.

    Values that are null or no numbers are left out; a group without any keeps its row, with nulls. Null keys are one
    group, NaN is the largest value. Without keys there is one row, or none for an empty input.
    """
    if not probabilities or not all(0 <= p <= 1 for p in probabilities.values()):
        raise ValueError("give probabilities from 0 to 1")
    keys = [f"__k{i}" for i in range(len(group_by))]
    numbers = df.select(*[field(k).alias(n) for n, k in zip(keys, group_by)], numeric_value(df, source).cast("double").alias("__x"))
    heavy = skew.heavy_groups(numbers, keys, max_group_rows)

    def plain(rows: DataFrame) -> DataFrame:
        wanted = F.percentile("__x", F.array(*[F.lit(float(p)) for p in probabilities.values()])).alias("__q")
        return rows.groupBy(*keys).agg(wanted, F.count(F.lit(1)).alias("__n")).filter("__n > 0") \
            .select(*keys, *[F.get("__q", F.lit(j)).alias(n) for j, n in enumerate(probabilities)])

    if heavy:
        ordinary, large = skew.split_heavy(numbers, keys, heavy)
        found = plain(ordinary)
        if not group_by:
            found = found.limit(0)  # the one group is the large one
        found = found.unionByName(_bracketed(large, keys, list(probabilities.items()), max_group_rows, heavy, accuracy))
    else:
        found = plain(numbers)
    return found.select(*[F.col(n).alias(k) for n, k in zip(keys, group_by)], *[field(n) for n in probabilities])


def _bracketed(rows: DataFrame, keys: list[str], wanted: list[tuple[str, float]], max_group_rows: int, heavy: skew.Heavy,
               accuracy: int) -> DataFrame:
    """Quantiles of large groups. The tables of brackets and counts have one row per large group."""
    slack, js = 4 / accuracy, range(len(wanted))
    ends = [min(max(p + d, 0.0), 1.0) for _, p in wanted for d in (-slack, slack)]
    sketched = rows.groupBy(*keys).agg(F.percentile_approx("__x", F.array(*map(F.lit, ends)), accuracy).alias("__ends"),
                                       F.count("__x").alias("__n"))
    sketched = materialize(sketched)

    def with_groups(groups: DataFrame) -> DataFrame:
        """The rows beside what is known of their group; they stay where they are if the table is small."""
        few = heavy.small(groups.select(*[F.col(k).alias(f"{k}g") for k in keys], *[c for c in groups.columns if c not in keys]))
        return rows.join(few, all_of([same(rows[k], few[f"{k}g"]) for k in keys]) if keys else F.lit(True)) \
            .drop(*[f"{k}g" for k in keys]).filter("__x IS NOT NULL")

    x = F.col("__x")
    counted = with_groups(sketched).groupBy(*keys).agg(*[c for j in js for c in (
        F.count_if(x < F.col("__ends")[2 * j]).alias(f"__b{j}"), F.count_if(x <= F.col("__ends")[2 * j + 1]).alias(f"__u{j}"))])
    both = sketched.alias("s").join(counted.alias("c"), all_of([same(F.col(f"s.{k}"), F.col(f"c.{k}")) for k in keys])
                                    if keys else F.lit(True))
    targets = []
    for j, (_, p) in enumerate(wanted):
        position = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(position).cast("bigint"), F.ceil(position).cast("bigint")
        holds = (F.col(f"__b{j}") <= low) & (high < F.col(f"__u{j}"))
        targets.append(F.struct(
            F.lit(j).alias("j"), F.when(holds, F.col("__ends")[2 * j]).alias("from"), F.when(holds, F.col("__ends")[2 * j + 1]).alias("upto"),
            (low - F.when(holds, F.col(f"__b{j}")).otherwise(0)).alias("lo"), (high - F.when(holds, F.col(f"__b{j}")).otherwise(0)).alias("hi"),
            (position - low).alias("part")))
    brackets = materialize(both.select(*[F.col(f"s.{k}").alias(k) for k in keys], F.array(*targets).alias("__targets")))
    inside = F.filter("__targets", lambda t: t["from"].isNull() | ((x >= t["from"]) & (x <= t["upto"])))
    values = with_groups(brackets).select(*keys, "__x", F.explode(inside).alias("__t")) \
        .groupBy(*keys, F.col("__t.j").alias("__j"), "__x").agg(F.count(F.lit(1)).alias("__c"))
    running = apply_window(values, "Sum", [*keys, "__j"], ["__x"], "__upto", "__c", max_group_rows=max_group_rows)
    ranks = heavy.small(brackets.select(*[F.col(k).alias(f"{k}g") for k in keys], F.explode("__targets").alias("__t")))
    placed = running.join(ranks, all_of([same(running[k], ranks[f"{k}g"]) for k in keys] + [F.col("__j") == F.col("__t.j")]))

    def at(rank: str) -> Column:
        # smallest value with more than that many values at or below it
        return F.min(F.when(F.col("__upto") > F.col(f"__t.{rank}"), x))

    found = placed.groupBy(*keys, "__j").agg(at("lo").alias("a"), at("hi").alias("b"), F.first("__t.part").alias("part"))
    # no arithmetic between equal neighbours: they may be infinite
    value = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")) \
        .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__j") == j, value)).alias(n) for j, (n, _) in enumerate(wanted)])
    if not keys:
        return wide
    every = sketched.select(*[F.col(k).alias(f"{k}g") for k in keys])
    return every.join(wide, all_of([same(every[f"{k}g"], wide[k]) for k in keys]), "left") \
        .select(*[F.col(f"{k}g").alias(k) for k in keys], *[n for n, _ in wanted])


def grouped_modes(df: DataFrame, group_by: list[str], source: str, target: str = "mode") -> DataFrame:
    """The group keys and the most frequent non-null value, ties to the smallest; null for a group without values.

    Counted by group and value first, then the best per group: both steps combine before their shuffle, so that one
    group of many rows, or of many distinct values, is spread.
    """
    counted = df.groupBy(*[field(k) for k in group_by], field(source).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    # nulls last, more frequent first, smaller first
    best = F.min_by("__v", F.struct(F.col("__v").isNull().alias("none"), (-F.col("__n")).alias("n"), F.col("__v").alias("v")))
    if group_by:
        return counted.groupBy(*[field(k) for k in group_by]).agg(best.alias(target))
    return counted.agg(F.count(F.lit(1)).alias("__rows"), best.alias(target)).filter("__rows > 0").drop("__rows")
