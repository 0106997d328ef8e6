"""Sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.columns import field
from millrace.operators.windows import number_rows

DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100
_DEEP = 100_000


def _order(name: str, descending: bool) -> Column:
    return field(name).desc_nulls_last() if descending else field(name).asc_nulls_first()


def sort_by(df: DataFrame, requested: str, allowed: list[str], default: str, tie_breaker: str,
            descending: bool = False) -> DataFrame:
    """Sort by one of the allowed fields; an unknown one falls back to the default."""
    chosen = {a.lower(): a for a in allowed}.get((requested or "").lower(), default)
    return df.orderBy(_order(chosen, descending), _order(tie_breaker, descending))


def _page_size(size: int | None) -> int:
    return min(max(size or DEFAULT_PAGE_SIZE, 1), MAX_PAGE_SIZE)


def page(df: DataFrame, order_by: list[str], tie_breaker: str, number: int = 1, size: int | None = None) -> DataFrame:
    """Rows of one page (numbers from 1) in the order of the fields and then of a unique one, so that pages never
    repeat or skip a row. Deep pages number the rows in parallel instead of skipping them."""
    order_by = [*order_by, tie_breaker]
    size, number = _page_size(size), max(number, 1)
    skip = (number - 1) * size
    if skip <= _DEEP:
        return df.orderBy(*[_order(o, False) for o in order_by]).offset(skip).limit(size)
    numbered = number_rows(df, [], order_by, "__n")
    return numbered.filter((F.col("__n") > skip) & (F.col("__n") <= skip + size)).orderBy("__n").drop("__n")


def page_info(df: DataFrame, number: int = 1, size: int | None = None) -> DataFrame:
    """One row: page number, size, total rows, pages, and whether a previous or next page exists."""
    size, number = _page_size(size), max(number, 1)
    pages = F.ceil(F.col("total_count") / size).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        F.lit(number).alias("page_number"), F.lit(size).alias("page_size"), "total_count",
        pages.alias("total_pages"),
        F.lit(number > 1).alias("has_previous"), (F.lit(number) < pages).alias("has_next"),
    )


def page_after(df: DataFrame, key: str, cursor=None, size: int | None = None, descending: bool = False) -> DataFrame:
    """Keyset page: rows past the cursor in key order, with ``has_more`` from one row beyond the page."""
    size = _page_size(size)
    if cursor is not None:
        df = df.filter(field(key) < F.lit(cursor)) if descending else df.filter(field(key) > F.lit(cursor))
    ahead = df.orderBy(_order(key, descending)).limit(size + 1)
    # at most 101 rows from here on
    seen = ahead.agg(F.count(F.lit(1)).alias("__seen"))
    return (
        ahead.limit(size).crossJoin(F.broadcast(seen))
        .withColumn("has_more", F.col("__seen") > size).drop("__seen")
        .orderBy(_order(key, descending))
    )


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row with the greatest ``newest`` values of each key, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[field(n).alias(f"o{i}") for i, n in enumerate(newest)])
    picked = df.groupBy(*[field(k) for k in keys]).agg(
        F.max_by(F.struct(*[field(c).alias(c) for c in rest]), place).alias("__row"))
    return picked.select(*[F.col("__row")[c].alias(c) if c in rest else field(c) for c in df.columns])
