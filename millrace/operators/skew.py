"""Finding and splitting key groups that are too large for one task.

``heavy_groups`` counts the rows of each group by the key's hash, which combines before the shuffle, and keeps the
groups above ``max_group_rows`` as a table (usually there are none, then the plain plan is used). That table has at most
rows / max_group_rows rows; its size is known before a broadcast is chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import NUMERIC, TEMPORAL, all_of, field, same
from millrace.session import materialize

MAX_GROUP_ROWS = 5_000_000     # a larger group is split
MAX_BROADCAST_GROUPS = 500_000  # of 16 bytes each; longer tables are joined as Spark decides


@dataclass(frozen=True)
class Heavy:
    """The groups that are too large: a written table of their hash ``h`` and rows ``n``. False if there are none."""

    table: DataFrame | None = None
    groups: int = 0

    def __bool__(self) -> bool:
        return self.groups > 0

    def small(self, table: DataFrame) -> DataFrame:
        """A table with one row per heavy group, broadcast if that is known to be small."""
        return F.broadcast(table) if self.groups <= MAX_BROADCAST_GROUPS else table


NONE = Heavy()


def key_hash(df: DataFrame, keys: list[str], types: list[T.DataType] | None = None) -> Column:
    """Hash of the key columns, equal wherever grouping treats the keys as equal; ``types`` casts them first."""
    parts = []
    for i, name in enumerate(keys):
        column, dtype = field(name), df.schema[name].dataType
        if types and types[i] != dtype:
            column, dtype = column.cast(types[i]), types[i]
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            column = column + F.lit(0.0)  # -0.0 and 0.0 group together
        parts.append(column)
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def common_types(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> list[T.DataType] | None:
    """Types under which each pair of keys is compared, or None where hashes cannot stand for the comparison."""
    out = []
    for a, b in zip(left_keys, right_keys):
        types = left.schema[a].dataType, right.schema[b].dataType
        if types[0] == types[1]:
            out.append(types[0])
        elif all(isinstance(t, NUMERIC) for t in types) or all(isinstance(t, TEMPORAL) for t in types):
            out.append(left.select(field(a).alias("x")).union(right.select(field(b).alias("x"))).schema[0].dataType)
        else:
            return None
    return out


def heavy_groups(df: DataFrame, keys: list[str], max_group_rows: int = MAX_GROUP_ROWS,
                 types: list[T.DataType] | None = None) -> Heavy:
    """The key groups with more than ``max_group_rows`` rows."""
    found = df.select(key_hash(df, keys, types).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > max_group_rows)
    if found.isEmpty():
        return NONE
    found = materialize(found)
    return Heavy(found, found.count())


def broadcasts(df: DataFrame) -> bool:
    """True where Spark's own size estimate puts the frame under its broadcast threshold, so that a join on it
    moves no rows of the other side and skew does not matter."""
    spark = df.sparkSession
    threshold = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower().rstrip("b")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    limit = int(threshold[:-1]) * units[threshold[-1]] if threshold[-1:] in units else int(threshold)
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # no JVM handle (Spark Connect): look for heavy keys instead
        return False
    return size <= limit


def split_heavy(df: DataFrame, keys: list[str], heavy: Heavy,
                types: list[T.DataType] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of heavy groups)."""
    hashed, groups = df.withColumn("__heavy_h", key_hash(df, keys, types)), heavy.small(heavy.table.select(F.col("h").alias("__heavy_h")))
    return (hashed.join(groups, "__heavy_h", "left_anti").drop("__heavy_h"),
            hashed.join(groups, "__heavy_h", "left_semi").drop("__heavy_h"))


def join_per_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                 right_keys: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                 null_safe: bool = True, heavy: Heavy | None = None) -> DataFrame:
    """Join rows to a table with at most one row per key (an aggregate or a deduplicated lookup).

    Rows of heavy keys meet their partner rows (one per heavy key) without a shuffle, so they are never moved into
    one task; all other rows take the ordinary shuffle join. ``how`` is inner, left, left_semi or left_anti. The
    right key columns are dropped.
    """
    right_keys = right_keys or keys
    renamed = [f"__key_{i}" for i in range(len(keys))]
    for old, new in zip(right_keys, renamed):
        right = right.withColumnRenamed(old, new)

    def joined(rows: DataFrame, partners: DataFrame) -> DataFrame:
        pairs = [same(rows[f"`{k}`"], partners[r]) if null_safe else rows[f"`{k}`"] == partners[r]
                 for k, r in zip(keys, renamed)]
        return rows.join(partners, all_of(pairs), how).drop(*renamed)

    types = common_types(left, right, keys, renamed)
    if heavy is None:
        heavy = NONE if types is None or broadcasts(right) else heavy_groups(left, keys, max_group_rows, types)
    if not heavy:
        return joined(left, right)
    right = materialize(right)  # two branches read it
    ordinary, large = split_heavy(left, keys, heavy, types)
    rest, few = split_heavy(right, renamed, heavy, types)
    return joined(ordinary, rest).unionByName(joined(large, heavy.small(few)))


def tiles(left: Heavy, right: Heavy, max_group_rows: int = MAX_GROUP_ROWS) -> Heavy:
    """Tasks to spread each heavy group of either side over: h, ``left`` and ``right`` tiles of about
    ``max_group_rows`` rows, 1 on a side where the group is not large."""
    sides = [side.table.select("h", *[F.ceil(F.col("n") / max_group_rows).cast("bigint").alias(n) if n == name
                                      else F.lit(1).cast("bigint").alias(n) for n in ("left", "right")])
             for side, name in ((left, "left"), (right, "right")) if side]
    table = materialize((sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))
                        .groupBy("h").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    return Heavy(table, table.count())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows written once with a number of their own, which a lost task finds again."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def salted_inner(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], on: Column,
                 spread: Heavy, types: list[T.DataType] | None = None) -> DataFrame:
    """Equi-join of heavy groups as a grid: each (left tile, right tile) pair of a key meets in its own task.

    A side is cut into as many tiles as its group is large (``tiles``), and repeated once per tile of the other side.
    Rows must be ``numbered`` as ``__lid`` and ``__rid``: the number's hash gives the tile, so equal rows spread too
    and earlier shuffles on the key do not matter.
    """
    table = spread.small(spread.table.select(F.col("h").alias("__h"), F.col("left").alias("__lefts"), F.col("right").alias("__rights")))

    def dealt(rows: DataFrame, keys: list[str], number: str, own: str, other: str, mine: str, every: str) -> DataFrame:
        known = rows.withColumn("__h", key_hash(rows, keys, types)).join(table, "__h")
        return known.withColumn(mine, F.pmod(F.xxhash64(number), F.col(own))) \
            .withColumn(every, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))) \
            .drop("__h", "__lefts", "__rights")

    l_rows = dealt(left, left_keys, "__lid", "__lefts", "__rights", "__lt", "__rt")
    r_rows = dealt(right, right_keys, "__rid", "__rights", "__lefts", "__rt2", "__lt2")
    met = on & (F.col("__lt") == F.col("__lt2")) & (F.col("__rt") == F.col("__rt2"))
    return l_rows.join(r_rows, met, "inner").drop("__lt", "__rt", "__lt2", "__rt2")
