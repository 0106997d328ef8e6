"""Hash trees over tables: equal sums mean equal tables, and unequal ones say where to look.

A row's digest encodes every field with its length, so no two rows share one. The digests of the rows are summed per
bucket, a prefix of the key's hash, at several levels: a node's sums are those of its children. Comparing two tables walks
their trees from the root and follows only nodes that differ; only rows in buckets that differ are then read and
shuffled. A tree can be stored beside its table, so that a later comparison reads no row of an unchanged one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import as_text, field
from millrace.operators import skew
from millrace.session import materialize

FAN_OUT_BITS = 4       # a node has 16 children
LEAF_ROWS = 64         # about so many rows per bucket: of 0.1 % changed rows, six buckets in a hundred know
MAX_BITS = 40
SUMS = ("s0", "s1")
WORD = "decimal(18,0)"


def encoded(value: Column, dtype: T.DataType) -> Column:
    """Text that differs wherever values of the type differ: each part has its length before it, and null is no text.

    Zeros of either sign are one value, as are NaNs; a map is its entries in the order of their encoded keys.
    """
    if isinstance(dtype, T.StructType):
        parts = [encoded(value.getField(f.name), f.dataType) for f in dtype.fields]
        text = F.when(value.isNotNull(), F.concat(F.lit("("), *parts, F.lit(")")))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: encoded(x, dtype.elementType))
        text = F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(items, ""), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(
            encoded(e["key"], dtype.keyType), encoded(e["value"], dtype.valueType)))
        text = F.concat(F.size(value).cast("string"), F.lit("{"), F.array_join(F.array_sort(entries), ""), F.lit("}"))
    else:
        plain = F.hex(value) if isinstance(dtype, T.BinaryType) else as_text(value, dtype)
        text = F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain)
    return F.coalesce(text, F.lit("-"))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """MD5 of a row's encoded columns, 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(""), *[encoded(field(c), df.schema[c].dataType) for c in columns]))


def words(digest: Column, count: int = 4) -> list[Column]:
    """A digest as four numbers of 32 bits or two of 56, whose sums are exact over 10^18 or 10^11 rows."""
    size = 32 // count
    return [F.conv(F.substring(digest, size * i + 1, min(size, 14)), 16, 10).cast(WORD) for i in range(count)]


def bits_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits of the key hash that make buckets of about ``leaf_rows`` rows, a whole number of levels."""
    bits = max(1, -(-rows // leaf_rows) - 1).bit_length()
    return min(MAX_BITS, max(1, -(-bits // FAN_OUT_BITS)) * FAN_OUT_BITS)


def bucket(df: DataFrame, keys: list[str], bits: int) -> Column:
    """The first ``bits`` bits of the hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(row_digest(df, keys)), 64 - bits)


def build(df: DataFrame, keys: list[str], columns: list[str] | None = None, bits: int = 16) -> DataFrame:
    """The tree of a table: ``level`` (0 is the root), ``node``, ``n`` (rows) and two sums of digests.

    It holds no node without rows, so an empty table has an empty tree. Rows are counted, not keys: repeated rows change
    the sums. Leaves come from one shuffle of digests, added up before it; the levels above from the leaves.
    """
    digest = row_digest(df, [*keys, *[c for c in columns or df.columns if c not in keys]])
    leaves = df.select(bucket(df, keys, bits).alias("node"), digest.alias("h")) \
        .select("node", *[w.alias(s) for w, s in zip(words(F.col("h"), 2), SUMS)]) \
        .groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS])
    leaves = materialize(leaves)
    levels = [leaves.select(F.lit(bits // FAN_OUT_BITS).alias("level"), "node", "n", *SUMS)]
    for level in reversed(range(bits // FAN_OUT_BITS)):
        above = leaves.groupBy(F.shiftright("node", bits - FAN_OUT_BITS * level).alias("node")) \
            .agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS])
        levels.append(above.select(F.lit(level).alias("level"), "node", "n", *SUMS))
    return reduce(DataFrame.unionByName, reversed(levels))


def differing(left: DataFrame, right: DataFrame) -> tuple[DataFrame, int, int]:
    """(the leaves ``node`` that differ between two trees of the same depth, their number, the levels that were read).

    Children are compared only below nodes that differ, so equal tables are told apart from the rest at the root.
    """
    depths = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    if None in depths:  # an empty table: all that the other has
        rest = left.unionByName(right)
        depth = max((d for d in depths if d is not None), default=0)
        leaves = materialize(rest.filter(F.col("level") == depth).select("node").distinct())
        return leaves, leaves.count(), 1
    if depths[0] != depths[1]:
        raise ValueError(f"trees of {depths[0]} and {depths[1]} levels do not compare")
    found, count = None, 0
    for level in range(depths[0] + 1):
        sides = [t.filter(F.col("level") == level).select("node", "n", *SUMS) for t in (left, right)]
        if found is not None:
            parents = F.broadcast(found) if count <= skew.MAX_BROADCAST_GROUPS else found
            sides = [s.withColumn("parent", F.shiftright("node", FAN_OUT_BITS)).join(
                parents.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent") for s in sides]
        both = sides[0].unionByName(sides[1].select("node", (-F.col("n")).alias("n"), *[(-F.col(s)).alias(s) for s in SUMS]))
        found = materialize(both.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])
                            .filter(" OR ".join(f"{c} <> 0" for c in ("n", *SUMS))).select("node"))
        count = found.count()
        if not count:
            return found, 0, level + 1
    return found, count, depths[0] + 1


def rows_in(df: DataFrame, keys: list[str], leaves: DataFrame, count: int, bits: int) -> DataFrame:
    """The rows whose bucket is one of ``leaves``; moved only if there are too many leaves to broadcast."""
    nodes = leaves.withColumnRenamed("node", "__node")
    nodes = F.broadcast(nodes) if count <= skew.MAX_BROADCAST_GROUPS else nodes
    return df.withColumn("__node", bucket(df, keys, bits)).join(nodes, "__node", "left_semi").drop("__node")


def changed_rows(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str],
                 leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both tables without the buckets in which they agree."""
    bits = bits_for(max(source.count(), destination.count()), leaf_rows)
    trees = [build(t, keys, columns, bits) for t in (source, destination)]
    leaves, count, _ = differing(*trees)
    return rows_in(source, keys, leaves, count, bits), rows_in(destination, keys, leaves, count, bits)
