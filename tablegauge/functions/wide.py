"""One wide aggregate per report: every statistic of every column in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, first_value, last_value
from tablegauge.functions.quantiles import outside


class WideStats:
    """A one-row frame holding ``n`` and the requested (statistic, column) pairs."""

    def __init__(self, df: DataFrame, wanted: dict[str, Sequence[str]],
                 order_by: Sequence[str] | None = None, bounds: dict | None = None,
                 extra: Iterable[Column] = ()):
        self._names: dict[tuple[str, str], str] = {}
        position = {c: i for i, c in enumerate(df.columns)}
        makers = {
            "missing": lambda c: F.count_if(col(c).isNull()),
            "mean": lambda c: F.avg(col(c)),
            "std": lambda c: F.stddev_samp(col(c)),
            "min": lambda c: F.min(col(c)).cast("double"),
            "max": lambda c: F.max(col(c)).cast("double"),
            "first": lambda c: first_value(c, order_by).cast("double"),
            "last": lambda c: last_value(c, order_by).cast("double"),
            "outliers": lambda c: F.count_if(outside(col(c), bounds[c])),
            "negative": lambda c: F.count_if(col(c) < 0),
            # One value and no more: cheaper than counting distinct values.
            "constant": lambda c: F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(False)),
        }
        aggs = [F.count(F.lit(1)).alias("n"), *extra]
        for stat, cols in wanted.items():
            for c in cols:
                name = f"{stat}_{position[c]}"
                self._names[stat, c] = name
                aggs.append(makers[stat](c).alias(name))
        self.row = df.agg(*aggs)
        self.n = F.col("n")

    def __call__(self, stat: str, c: str) -> Column:
        return F.col(self._names[stat, c])

    def total_missing(self, cols: Sequence[str]) -> Column:
        total = F.lit(0).cast("bigint")
        for c in cols:
            total = total + self("missing", c)
        return total

    def completeness(self, cols: Sequence[str]) -> Column:
        """Share of filled cells in percent, 100 for a table without cells."""
        cells = self.n * F.lit(len(cols))
        return F.coalesce((1 - F.try_divide(self.total_missing(cols), cells)) * 100, F.lit(100.0))

    def cv(self, c: str) -> Column:
        """Signed coefficient of variation; NULL for a zero mean."""
        return F.when(self("mean", c) != 0, self("std", c) / self("mean", c))


def correlation(a: str, b: str, complete: bool = False) -> Column:
    """Pearson correlation over rows with both values, NULL for a constant side.

    ``corr`` raises on a constant column under ANSI rules. If both columns are
    ``complete``, deviations are per column and shared by all pairs of one
    aggregate.
    """
    x, y = col(a).cast("double"), col(b).cast("double")
    if complete:
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.try_divide(F.regr_sxy(x, y), F.sqrt(F.regr_sxx(x, y)) * F.sqrt(F.regr_syy(x, y)))


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the non-null values among expressions of one row, NULL if none."""
    if not values:
        return F.lit(None).cast("double")
    kept = F.filter(F.array(*values), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(kept))


def names_where(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]), lambda x: x.isNotNull())


def numbered(row: DataFrame, texts: Sequence[Column], name: str = "recommendation") -> DataFrame:
    """Non-null texts of a one-row frame as (position, text), numbered from 1."""
    kept = F.filter(F.array(*texts), lambda x: x.isNotNull())
    return row.select(F.posexplode(kept).alias("p", name)).select(
        (F.col("p") + 1).alias("position"), name)
