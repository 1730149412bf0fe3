"""Pages and samples of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import with_row_index

MAX_PAGE = 500
TOP_ROWS = 100_000


def total_order(df: DataFrame, order_by: Sequence[str]) -> list[str | Column]:
    """The given order, completed by a hash of the whole row, so that only identical rows tie."""
    values = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in df.schema]
    return [*order_by, F.xxhash64(*values)]


def rows_between(df: DataFrame, order_by: Sequence[str], start: int, size: int) -> DataFrame:
    """``size`` rows from position ``start`` of the table in the given order.

    Early rows are a top-k. That keeps all rows up to them in one place, so
    later ones are cut from the distributed row index; both follow one order.
    """
    order = total_order(df, order_by)
    if start + size <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(size)
    at = F.col("row_index")
    return with_row_index(df, order).filter((at >= start) & (at < start + size)).orderBy("row_index").drop("row_index")


def page_rows(df: DataFrame, order_by: Sequence[str], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the table in the given order, at most 500 rows."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and page_size between 1 and {MAX_PAGE}")
    return rows_between(df, order_by, (page - 1) * page_size, page_size)


def sample_rows(df: DataFrame, order_by: Sequence[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """``limit`` rows from position ``offset`` of the order, at most 500."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative and limit between 1 and {MAX_PAGE}")
    return rows_between(df, order_by, offset, limit)


def sample_for_profile(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of the rows a profile should read. Which share is enough is the caller's choice."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be over 0 and at most 1")
    return df if fraction == 1 else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def preview(df: DataFrame, rows: int = 100, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows, each with the table's size and column types alongside.

    Without an order these are whichever rows are read first.
    """
    kinds = ", ".join(f"{c}: {t}" for c, t in df.dtypes)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = df.orderBy(*order_by) if order_by else df
    return head.limit(rows).select(
        "*", total.alias("row_count"), F.lit(len(df.columns)).alias("column_count"), F.lit(kinds).alias("dtypes"))
