"""Joins and steps that need more than one statement to stay efficient."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, free_names, with_row_index
from tablegauge.functions.ordered import running_total


LEVELS = 48  # a range covers at most 2^48 buckets
COUNT_BLOCK = 200_000  # distinct values and bounds that one task adds up


def dyadic_cells(first: Column, last: Column) -> Column:
    """The buckets from ``first`` to ``last`` as cells of 2^level buckets, at most two a level: (level, cell) structs.

    A cell is listed where it lies inside the range and the cell twice its size around it does not.
    """
    cells = []
    for level in range(LEVELS + 1):
        left, right = -F.shiftright(-first, level), F.shiftright(last + 1, level) - 1
        cells += [F.when((left <= right) & (side.bitwiseAND(F.lit(1)) == odd), F.struct(F.lit(level).alias("level"), side.alias("cell")))
                  for side, odd in ((left, 1), (right, 0))]
    return F.array_compact(F.array(*cells))


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str,
               width: float, keep: Sequence[Column] | None = None, count: str | None = None) -> DataFrame:
    """Rows of ``left`` with ``low <= value < high`` of ``right``, joined by dyadic cells of buckets.

    A range of any length is listed under at most two cells of each size, so a long one costs rows by the logarithm of
    its length. A value is looked up under its cell of every size that occurs; the join is on equality, and the rest of
    the condition filters within a cell. ``width`` is the smallest cell, about the length of a short range. Missing values
    and empty ranges meet nothing.

    With ``count`` the pairs are counted instead of listed: every row of ``right`` that meets any comes once, with their
    number in the column of that name. Pairs grow with both tables at once, their counts do not.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    if count is not None:
        if keep:
            raise ValueError("counts have no columns of the left table to keep")
        return _range_counts(left, right, value, low, high, count)
    level, cell, cells = free_names([*left.columns, *right.columns], "_level", "_cell", "_cells")

    def bucket(c: str) -> Column:
        return F.floor(col(c).cast("double") / width).cast("bigint")

    spread = right.filter(col(low) < col(high)).withColumn(cells, F.explode(dyadic_cells(bucket(low), bucket(high)))).withColumns(
        {level: F.col(cells)["level"], cell: F.col(cells)["cell"]}).drop(cells)
    used = spread.agg(F.sort_array(F.collect_set(level))).first()[0]  # at most LEVELS numbers
    places = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(bucket(value), n).alias("cell")) for n in used or [0]])
    points = left.withColumn(cells, F.explode(places)).withColumns({level: F.col(cells)["level"], cell: F.col(cells)["cell"]}).drop(cells)
    joined = points.join(spread, [level, cell]).filter((col(value) >= col(low)) & (col(value) < col(high))).drop(level, cell)
    return joined.select(*keep) if keep else joined


def _range_counts(left: DataFrame, right: DataFrame, value: str, low: str, high: str, count: str) -> DataFrame:
    """Rows of ``right`` with the number of values in their range: those below ``high`` without those below ``low``.

    Values and bounds are reduced to one row per distinct number, put in order and added up in blocks, so neither a
    frequent value nor a long range weighs more than another.
    """
    ranges = right.filter(col(low) < col(high))
    values = left.select(col(value).alias("at")).filter(F.col("at").isNotNull()).groupBy("at").agg(F.count(F.lit(1)).alias("rows"))
    bounds = ranges.select(F.explode(F.array(col(low), col(high))).alias("at")).distinct().withColumn("rows", F.lit(0).cast("bigint"))
    places = values.unionByName(bounds).groupBy("at").agg(F.sum("rows").alias("rows"))
    totals = running_total(with_row_index(places, ["at"]), {"up_to": "rows"}, block=COUNT_BLOCK)
    at_low, at_high, under_low, under_high = free_names([*right.columns, count], "_at_low", "_at_high", "_under_low", "_under_high")

    def below(at: str, under: str) -> DataFrame:
        return totals.select(F.col("at").alias(at), (F.col("up_to") - F.col("rows")).alias(under))

    met = (ranges.join(below(at_low, under_low), col(low) == F.col(at_low))
           .join(below(at_high, under_high), col(high) == F.col(at_high)))
    return met.select(*[col(c) for c in right.columns], (F.col(under_high) - F.col(under_low)).alias(count)).filter(col(count) > 0)


def run_pipeline(df: DataFrame, steps: Iterable[Mapping], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply an ordered list of declared steps: filter, map, aggregate, join.

    {"kind": "filter", "condition": sql}
    {"kind": "map", "columns": {name: sql}}
    {"kind": "aggregate", "by": [names], "measures": {name: sql}}
    {"kind": "join", "table": name, "on": [names], "how": type}

    Join sides carry no hint: Spark broadcasts a side only below its size
    threshold and AQE splits hot keys of a shuffled join.
    """
    for step in steps:
        kind = step["kind"]
        if kind == "filter":
            df = df.filter(F.expr(step["condition"]))
        elif kind == "map":
            df = df.withColumns({n: F.expr(e) for n, e in step["columns"].items()})
        elif kind == "aggregate":
            df = df.groupBy(*step.get("by", [])).agg(
                *[F.expr(e).alias(n) for n, e in step["measures"].items()])
        elif kind == "join":
            df = df.join(tables[step["table"]], list(step["on"]), step.get("how", "inner"))
        else:
            raise ValueError(f"unknown step kind: {kind}")
    return df
