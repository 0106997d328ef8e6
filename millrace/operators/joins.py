"""Joins on lists of field comparisons.

Right columns whose name is taken get a ``right_`` prefix. Conditions are ANDed; with at least one equality
the join shuffles on it and re-checks the rest. Whatever compares all pairs needs an explicit ``allow_cross``: a
lone inner ordering comparison then goes through the bucketed inequality join, the rest through a cross join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import NUMERIC, TEMPORAL, all_of
from millrace.operators import skew
from millrace.session import materialize

JOIN_TYPES = {"Inner": "inner", "Left": "left", "Right": "right", "Full": "full", "Cross": "cross"}
INEQUALITY_TASK_ROWS = 1_000_000  # left rows of a lone ordering comparison that meet in one task
_COMPARE = {
    "Equal": lambda a, b: a == b,
    "NotEqual": lambda a, b: a != b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class On:
    left: str
    right: str
    operator: str = "Equal"


def _disjoint(left: DataFrame, right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    taken = {c.lower() for c in left.columns}
    names: dict[str, str] = {}
    for column in right.columns:
        name = column
        while name.lower() in taken:
            name = "right_" + name
        taken.add(name.lower())
        names[column] = name
    return right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _test(left: DataFrame, right: DataFrame, names: dict[str, str], conditions: list[On]) -> Column:
    return all_of([_COMPARE[c.operator](left[f"`{c.left}`"], right[f"`{names[c.right]}`"]) for c in conditions])


def apply_join(left: DataFrame, right: DataFrame, how: str = "Inner", conditions: list[On] | None = None,
               allow_cross: bool = False, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Join two DataFrames; heavy keys of pure equality joins are split over many tasks."""
    conditions = [c if isinstance(c, On) else On(**c) for c in conditions or []]
    kind = JOIN_TYPES[how]
    right, names = _disjoint(left, right)
    if kind == "cross" or not conditions:
        if not allow_cross:
            raise ValueError("a join without conditions needs allow_cross=True")
        return left.crossJoin(right)
    equal = [c for c in conditions if c.operator == "Equal"]
    if not equal and kind == "inner" and len(conditions) == 1 and conditions[0].operator != "NotEqual":
        only = conditions[0]
        if allow_cross and skew.common_types(left, right, [only.left], [names[only.right]]) is not None \
                and isinstance(left.schema[only.left].dataType, NUMERIC + TEMPORAL):
            return inequality_join(left, right, only.left, names[only.right], only.operator)
    if equal:
        return _equality_join(left, right, names, conditions, equal, kind, max_group_rows)
    if not allow_cross:
        raise ValueError("a join without an equality compares all pairs and needs allow_cross=True")
    return left.join(right, _test(left, right, names, conditions), kind)


def _equality_join(left: DataFrame, right: DataFrame, names: dict[str, str], conditions: list[On], equal: list[On],
                   kind: str, max_group_rows: int) -> DataFrame:
    """Shuffle join on the equalities, the other comparisons re-checked; heavy keys go through the grid.

    Keys of unequal numeric or temporal types are hashed under their common type; other unequal types (text against
    a number) have no common hash and are left to Spark.
    """
    l_keys, r_keys = [c.left for c in equal], [names[c.right] for c in equal]
    types = skew.common_types(left, right, l_keys, r_keys)
    small = (kind in ("inner", "left") and skew.broadcasts(right)) or (kind in ("inner", "right") and skew.broadcasts(left))
    l_heavy = r_heavy = skew.NONE
    if types is not None and not small:
        l_heavy = skew.heavy_groups(left, l_keys, max_group_rows, types)
        r_heavy = skew.heavy_groups(right, r_keys, max_group_rows, types)
    if not l_heavy and not r_heavy:
        return left.join(right, _test(left, right, names, conditions), kind)
    spread = skew.tiles(l_heavy, r_heavy, max_group_rows)
    l_rest, l_big = skew.split_heavy(left, l_keys, spread, types)
    r_rest, r_big = skew.split_heavy(right, r_keys, spread, types)
    # tiles follow a row's own number; it also tells which outer rows no tile has matched
    l_big, r_big = skew.numbered(l_big, "__lid"), skew.numbered(r_big, "__rid")
    residual = len(equal) < len(conditions)
    met = all_of([_COMPARE[c.operator](F.col(f"`{c.left}`"), F.col(f"`{names[c.right]}`")) for c in conditions])
    matched = skew.salted_inner(l_big, r_big, l_keys, r_keys, met, spread, types)
    parts = [l_rest.join(r_rest, _test(l_rest, r_rest, names, conditions), kind), matched]
    if kind in ("left", "full"):
        parts.append(l_big.join(matched.select("__lid").distinct(), "__lid", "left_anti") if residual
                     else _unmatched(l_big, r_big, l_keys, r_keys, spread))
    if kind in ("right", "full"):
        parts.append(r_big.join(matched.select("__rid").distinct(), "__rid", "left_anti") if residual
                     else _unmatched(r_big, l_big, r_keys, l_keys, spread))
    columns = left.columns + right.columns
    whole = parts[0].select(*[F.col(f"`{c}`") for c in columns])
    for part in parts[1:]:
        whole = whole.unionByName(part.drop("__lid", "__rid"), allowMissingColumns=True)
    return whole.select(*[F.col(f"`{c}`") for c in columns])


def _unmatched(rows: DataFrame, others: DataFrame, keys: list[str], other_keys: list[str],
               heavy: skew.Heavy) -> DataFrame:
    present = others.select(*[F.col(f"`{k}`") for k in other_keys]).distinct()
    return skew.join_per_key(rows, present, keys, "left_anti", other_keys, null_safe=False, heavy=heavy)


def _position(dtype: T.DataType, column: Column) -> Column:
    """A value of a common type as a double that keeps its order (not always its difference)."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), column).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return column.cast("double")


def inequality_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, operator: str,
                    task_rows: int = INEQUALITY_TASK_ROWS) -> DataFrame:
    """Inner join on a single ordering comparison of two numeric or two temporal columns.

    Its result grows with the product of both sides, which is why ``apply_join`` asks for ``allow_cross``. Both sides
    are compared under their common type and cut at the same value bounds. A right row meets the left rows of its own
    bucket (with the comparison re-checked) and every left row of the buckets wholly on the right side of it. The
    number of buckets, and the tiles a bucket of more than ``task_rows`` left rows (equal values, say) is dealt into,
    follow from the rows counted; a right row is repeated once per tile.
    """
    types = skew.common_types(left, right, [left_key], [right_key])
    if types is None:
        raise ValueError("an ordering comparison needs two numeric or two temporal columns")
    dtype = types[0]

    def position(df: DataFrame, key: str) -> Column:
        return _position(dtype, df[f"`{key}`"].cast(dtype))

    l_pos, r_pos = position(left, left_key), position(right, right_key)
    l_rows = left.filter(left[f"`{left_key}`"].isNotNull()).withColumn("__p", l_pos)
    buckets = max(1, -(-l_rows.count() // task_rows))
    bounds = l_rows.agg(F.percentile_approx("__p", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10 * buckets)
                        ).first()[0] if buckets > 1 else []
    cuts = sorted(set(bounds or []))
    lower = operator in ("GreaterThan", "GreaterThanOrEqual")

    def bucket(place: Column) -> Column:
        """Number of cuts at or below the value."""
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= place)) if cuts else F.lit(0)

    # a row's own number spreads the rows of one bucket, equal values included, over tiles
    l_rows = skew.numbered(l_rows.withColumn("__b", bucket(F.col("__p"))), "__lid")
    sizes = materialize(l_rows.groupBy("__b").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("__tiles")))
    l_rows = l_rows.join(F.broadcast(sizes), "__b").withColumn("__t", F.pmod(F.xxhash64("__lid"), F.col("__tiles")).cast("int"))
    r_bucket = bucket(r_pos)
    reach = F.sequence(r_bucket, F.lit(len(cuts))) if lower else F.sequence(F.lit(0), r_bucket)
    r_rows = right.filter(right[f"`{right_key}`"].isNotNull()).withColumn("__rb", F.explode(reach)) \
        .join(F.broadcast(sizes.withColumnsRenamed({"__b": "__rb", "__tiles": "__rtiles"})), "__rb") \
        .withColumn("__rt", F.explode(F.sequence(F.lit(0), F.col("__rtiles") - 1)))
    check = _COMPARE[operator](F.col(f"`{left_key}`"), F.col(f"`{right_key}`"))
    met = (l_rows["__b"] == r_rows["__rb"]) & (l_rows["__t"] == r_rows["__rt"]) & check
    return l_rows.join(r_rows, met, "inner").drop("__b", "__t", "__p", "__lid", "__tiles", "__rb", "__rt", "__rtiles")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float,
               keys: list[tuple[str, str]] = (), max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Points joined to the ranges that hold them (``low <= point <= high``), numbers or times, and whose ``keys``
    (pairs of a points' and a ranges' column) are equal.

    Points and ranges meet on ``floor(value / step)``, where a range's step is the smallest of width, 16 widths, 256
    widths and so on that is not shorter than the range, so that it touches at most two buckets of its level; a point
    looks once at each level in use. The bounds are re-checked. ``width`` is in the column's unit (seconds for times,
    days for dates); near the usual range length is best. Busy buckets are split like any heavy join key.
    """
    ranges, names = _disjoint(points, ranges)
    low, high = names[low], names[high]
    types = skew.common_types(points, ranges, [point, point], [low, high])
    if types is None:
        raise ValueError("points and bounds need to be all numeric or all temporal")
    dtype = next((t for t in types if isinstance(t, (T.TimestampType, T.TimestampNTZType))), types[0])
    scale = width * (1.0 if isinstance(dtype, NUMERIC + (T.DateType,)) else 1e6)

    def place(column: str) -> Column:
        return _position(dtype, F.col(f"`{column}`").cast(dtype)) / F.lit(scale)

    r = ranges.filter(F.col(f"`{low}`") <= F.col(f"`{high}`")).withColumns({"__from": place(low), "__to": place(high)})
    length = F.greatest(F.col("__to") - F.col("__from"), F.lit(1.0))
    r = r.withColumn("__level", F.ceil(F.log2(length) / 4).cast("int"))
    levels = sorted(x["__level"] for x in r.select("__level").distinct().collect())  # one per factor of 16 in length
    step = F.pow(F.lit(16.0), F.col("__level"))
    r = r.withColumn("__rb", F.explode(F.array_distinct(F.array(F.floor(F.col("__from") / step), F.floor(F.col("__to") / step)))))
    p = points.filter(F.col(f"`{point}`").isNotNull()).withColumn("__plevel", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))) \
        .withColumn("__b", F.floor(place(point) / F.pow(F.lit(16.0), F.col("__plevel"))))
    on = [On("__plevel", "__level"), On("__b", "__rb"), On(point, low, "GreaterThanOrEqual"), On(point, high, "LessThanOrEqual"),
          *[On(a, names[b]) for a, b in keys]]
    extra = ["__b", "__plevel", "__level", "__rb", "__from", "__to"]
    return apply_join(p, r, "Inner", on, max_group_rows=max_group_rows).drop(*extra)


def missing_rows(source: DataFrame, destination: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key is absent from the destination (keys null-safe)."""
    present = destination.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    return skew.join_per_key(source, present, keys, "left_anti")
