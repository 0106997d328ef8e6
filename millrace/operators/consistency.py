"""Comparing a destination with its source, and bringing it up to date.

Keys are typed and null-safe. Where a key occurs more than once the last row wins: last by ``order_by``, or by
the compared values when no order is given. Both sides are compared in one aggregation by key over their union:
one shuffle, nulls group like any key, and repeated keys are combined before the shuffle, so no key can pile up
in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.columns import any_of, field, same
from millrace.operators import hashtree, skew


def _has_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString()


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A value that compares and orders: maps, which do neither, as text."""
    return hashtree.encoded(value, dtype) if _has_map(dtype) else value


def differ(left: Column, right: Column, schema: T.StructType, columns: list[str]) -> Column:
    """Whether the named fields of two row structs of the same types differ."""
    return any_of([~same(*[comparable(side[c], schema[c].dataType) for side in (left, right)]) for c in columns])


def paired(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str],
           order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the keys, and the row structs ``src`` and ``dst`` (null where a side lacks the key)."""
    if not keys:
        raise ValueError("at least one key column must be provided")
    order = order_by or []
    needed = list(dict.fromkeys([*keys, *columns, *order]))

    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(*[field(c) for c in needed], F.lit(side).alias("__side"))

    row = F.struct(F.lit(True).alias("__present"), *[field(c).alias(c) for c in columns])
    both = tagged(left, 0).unionByName(tagged(right, 1)).select(
        *[field(k) for k in keys], "__side", row.alias("__row"),
        *([F.struct(*[field(o).alias(f"o{i}") for i, o in enumerate(order)]).alias("__at")] if order else []))

    row_type = both.schema["__row"].dataType
    if order:
        both = both.withColumn("__at", comparable_struct(F.col("__at"), both.schema["__at"].dataType))
    elif _has_map(row_type):
        both = both.withColumn("__at", comparable_struct(F.col("__row"), row_type))

    def last(side: int) -> Column:
        mine = F.col("__side") == side
        if "__at" in both.columns:
            return F.max_by(F.when(mine, F.col("__row")), F.when(mine, F.col("__at")))
        return F.max(F.when(mine, F.col("__row")))

    return both.groupBy(*[field(k) for k in keys]).agg(last(0).alias("src"), last(1).alias("dst"))


def comparable_struct(row: Column, dtype: T.StructType) -> Column:
    """A row struct by which rows can be ordered."""
    return F.struct(*[comparable(row[f.name], f.dataType).alias(f.name) for f in dtype.fields]) if _has_map(dtype) else row


def _shared(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None) -> list[str]:
    if not keys:
        raise ValueError("at least one key column must be provided")
    if columns is not None:
        return [c for c in columns if c not in keys]
    return [c for c in source.columns if c not in keys and c in destination.columns]


def _unlike(pairs: DataFrame, columns: list[str]) -> Column:
    return differ(F.col("src"), F.col("dst"), pairs.schema["src"].dataType, columns)


def metrics(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None = None,
            order_by: list[str] | None = None) -> DataFrame:
    """One row: missing, different, total (distinct source keys). Destination-only keys are not counted."""
    compared = _shared(source, destination, keys, columns)
    pairs = paired(source, destination, keys, compared, order_by)
    here, there = F.col("src").isNotNull(), F.col("dst").isNotNull()
    return pairs.agg(F.count_if(here & ~there).alias("missing"),
                     F.count_if(here & there & _unlike(pairs, compared)).alias("different"), F.count_if(here).alias("total"))


def is_consistent(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None = None,
                  order_by: list[str] | None = None) -> DataFrame:
    """One row, one boolean: nothing missing and nothing different."""
    found = metrics(source, destination, keys, columns, order_by)
    return found.select(((F.col("missing") == 0) & (F.col("different") == 0)).alias("consistent"))


def differences(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None = None,
                order_by: list[str] | None = None, by_tree: bool = False) -> DataFrame:
    """Source rows that are missing from or differ in the destination, with ``status``.

    ``by_tree`` suits large tables of which little has changed: hash trees of both are compared first, and only rows in
    buckets that differ are shuffled. It reads both tables twice, and needs compared columns of equal types.
    """
    compared = _shared(source, destination, keys, columns)
    if by_tree:
        needed = list(dict.fromkeys([*keys, *compared, *(order_by or [])]))
        unlike = [c for c in needed if source.schema[c].dataType != destination.schema[c].dataType]
        if unlike:
            raise ValueError(f"columns of different types: {unlike}")
        source, destination = hashtree.changed_rows(source.select(*[field(c) for c in needed]),
                                                    destination.select(*[field(c) for c in needed]), keys, needed)
    pairs = paired(source, destination, keys, compared, order_by).filter(F.col("src").isNotNull())
    status = F.when(F.col("dst").isNull(), "missing").when(_unlike(pairs, compared), "different")
    return pairs.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        *[field(k) for k in keys], *[F.col("src")[c].alias(c) for c in compared], "status")


# Stand-ins for a null key of each type (told apart from the real value by a null flag).
_STAND_INS = {T.StringType: "''", T.BooleanType: "false", T.DateType: "DATE'1970-01-01'",
              T.TimestampType: "TIMESTAMP'1970-01-01'", T.TimestampNTZType: "TIMESTAMP_NTZ'1970-01-01'"}


def _null_free(df: DataFrame, keys: list[str]) -> list[Column]:
    """Key columns ``__v…`` and null flags ``__f…`` that compare by plain equality.

    Grouping and joining by them needs one shuffle; a null-safe join would shuffle a grouped side again.
    """
    parts = []
    for i, k in enumerate(keys):
        dtype = df.schema[k].dataType
        stand_in = F.expr(_STAND_INS.get(type(dtype), "0")).cast(dtype)
        parts += [F.coalesce(field(k), stand_in).alias(f"__v{i}"), field(k).isNull().alias(f"__f{i}")]
    return parts


def upsert(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None = None,
           order_by: list[str] | None = None, max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """The destination after inserting missing rows and updating the rest; nothing is deleted.

    Every destination row of a known key takes the source values of the synchronised columns.
    """
    synced = _shared(source, destination, keys, columns)
    typed = source.select(*[field(k).cast(destination.schema[k].dataType).alias(k) for k in keys],
                          *[field(c).cast(destination.schema[c].dataType).alias(c) if c in synced else field(c)
                            for c in source.columns if c not in keys])
    row = F.struct(*[field(c).alias(c) for c in keys + synced])
    at = [comparable(field(c), typed.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(order_by or keys + synced)]
    plain = not order_by and not any(_has_map(typed.schema[c].dataType) for c in synced)
    picked = F.max(row) if plain else F.max_by(row, F.struct(*at))
    joint = [f"__{p}{i}" for i in range(len(keys)) for p in "vf"]
    incoming = typed.select("*", *_null_free(typed, keys)).groupBy(*joint).agg(picked.alias("__src"))
    current = destination.select("*", *_null_free(destination, keys))

    def merged(name: str) -> Column:
        known = F.col("__src").isNotNull()
        return F.when(known, F.col("__src")[name]).otherwise(field(name)) if name in keys + synced else field(name)

    output = [merged(c).alias(c) for c in destination.columns]
    heavy = skew.heavy_groups(current, joint, max_group_rows)
    if not heavy:
        return current.join(incoming, joint, "full").select(*output)
    updated = skew.join_per_key(current, incoming, joint, "left", heavy=heavy).select(*output)
    fresh = incoming.join(current.select(*joint).distinct(), joint, "left_anti")
    inserted = fresh.select(*[
        (F.col("__src")[c] if c in keys + synced else F.lit(None).cast(destination.schema[c].dataType)).alias(c)
        for c in destination.columns])
    return updated.unionByName(inserted)


def upsert_count(source: DataFrame, destination: DataFrame, keys: list[str], columns: list[str] | None = None,
                 order_by: list[str] | None = None) -> DataFrame:
    """One row: inserted, updated and their sum."""
    found = metrics(source, destination, keys, columns, order_by)
    return found.select(F.col("missing").alias("inserted"), F.col("different").alias("updated"),
                        (F.col("missing") + F.col("different")).alias("changed"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row count and an order-free checksum, the sums of the four words of every row's digest. Rows that differ
    have different digests, so tables with equal checksums are equal, but for a chance of about 2^-128."""
    digest = hashtree.row_digest(df, columns or df.columns)
    own = df.select(digest.alias("h")).select(*[w.alias(f"w{i}") for i, w in enumerate(hashtree.words(F.col("h")))])
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return own.agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *sums).alias("checksum"))
