"""Insights over a whole table: trends, outliers, correlations, growth, risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    col, first_value, last_value, nan_to_null, numeric_columns, one_row_to_long, with_row_index)
from tablegauge.functions.gramian import pair_table
from tablegauge.functions.positions import boundaries, mean_after, mean_before, row_key
from tablegauge.functions.quantiles import exact_quantiles, iqr_bounds
from tablegauge.functions.wide import WideStats, mean_of, names_where, numbered

PAIR_SCHEMA = "pair_position int, column1 string, column2 string, correlation double"

# The two general lines every recommendation list ends with.
GENERAL_ADVICE = (
    "Monitor key metrics regularly for early trend detection",
    "Consider expanding dataset with additional features for better predictive power",
)


# How findings are worded.
TREND_TEXT = "%s shows %s trend"
OUTLIER_TEXT = "%d outliers detected in %s"
SPARSE_TEXT = "Consider addressing data quality issues: %s have significant missing values"
CONSTANT_TEXT = "%s has no variation - may not be useful for analysis"


def percent_change(first: Column, last: Column, n: Column) -> Column:
    """Change from first to last in percent; 0 for a zero start or one row."""
    return F.when((n > 1) & (first != 0), (last - first) / first * 100).otherwise(0.0)


def dataset_summary(df: DataFrame) -> DataFrame:
    names = ", ".join(numeric_columns(df))
    width = len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("row_count"))
    text = F.format_string(f"Dataset contains %d rows and {width} columns.", F.col("row_count"))
    if names:
        text = F.concat(text, F.lit(f" Key numeric metrics available: {names}"))
    return row.select("row_count", F.lit(width).cast("bigint").alias("column_count"),
                      F.lit(names).alias("numeric_names"), text.alias("summary"))


def trends(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First against last row of the order; the change is spread over all rows."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    s = WideStats(df, {"first": cols, "last": cols}, order_by)
    direction = {c: F.when(s("last", c) > s("first", c), "increasing").otherwise("decreasing") for c in cols}
    return one_row_to_long(s.row.filter("n > 1"), [
        F.struct(
            F.lit(c).alias("column_name"), direction[c].alias("direction"),
            ((s("last", c) - s("first", c)) / s.n).alias("average_change"),
            F.format_string(TREND_TEXT, F.lit(c), direction[c]).alias("description"))
        for c in cols], "column_name string, direction string, average_change double, description string")


def iqr_outliers(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """Values strictly outside the 1.5 IQR fences; percentage over all rows."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"outliers": cols}, bounds=bounds)
    long = one_row_to_long(s.row, [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(bounds[c][0]).cast("double").alias("lower_bound"),
            F.lit(bounds[c][1]).cast("double").alias("upper_bound"),
            s("outliers", c).alias("outlier_count"),
            F.try_divide(s("outliers", c) * 100.0, s.n).alias("percentage"),
            F.format_string(OUTLIER_TEXT, s("outliers", c), F.lit(c)).alias("description"))
        for c in cols], "column_name string, lower_bound double, upper_bound double, outlier_count bigint, "
                        "percentage double, description string")
    return long.filter("outlier_count > 0") if only_positive else long


def pair_correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of every numeric column pair, pairwise over non-nulls, from one scan of the table.

    (pair_position, column1, column2, correlation); null for a constant side or a pair without common rows.
    """
    df = nan_to_null(df)
    cols = numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    return pair_table(df, cols, PAIR_SCHEMA)


def correlations(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every pair over the threshold, the strongest first."""
    r = F.col("correlation")
    return (
        pair_correlations(df).filter(F.abs(r) > threshold)
        .orderBy(F.abs(r).desc(), "pair_position")
        .select("column1", "column2", "correlation",
                F.when(F.abs(r) > 0.7, "strong").otherwise("moderate").alias("strength"))
    )


def recommendations(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns, "constant": df.columns})
    sparse = names_where([(c, s("missing", c) > s.n * 0.1) for c in df.columns])
    texts = [F.when(F.size(sparse) > 0, F.format_string(SPARSE_TEXT, F.array_join(sparse, ", ")))]
    texts += [F.when(s("constant", c), F.format_string(CONSTANT_TEXT, F.lit(c))) for c in df.columns]
    texts += [F.lit(t) for t in GENERAL_ADVICE]
    return numbered(s.row, texts)


def key_metrics(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    cols = numeric_columns(df)
    quantiles = exact_quantiles(df, cols, [0.5])
    s = WideStats(df, {"mean": cols, "std": cols, "min": cols, "max": cols})
    return one_row_to_long(s.row, [
        F.struct(F.lit(c).alias("column_name"), s("mean", c).alias("mean"),
                 F.lit(quantiles[c][0]).cast("double").alias("median"), s("std", c).alias("std"),
                 s("min", c).alias("min"), s("max", c).alias("max"))
        for c in cols], "column_name string, mean double, median double, std double, min double, max double")


def executive_kpis(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    df = nan_to_null(df)
    cols = numeric_columns(df)
    s = WideStats(df, {"mean": cols, "min": cols, "max": cols, "first": cols, "last": cols}, order_by)
    trend = {c: percent_change(s("first", c), s("last", c), s.n) for c in cols}
    return one_row_to_long(s.row, [
        F.struct(F.lit(c).alias("name"), s("mean", c).alias("value"), trend[c].alias("trend"),
                 F.when(trend[c] > 0, "up").otherwise("down").alias("trend_direction"),
                 s("min", c).alias("min"), s("max", c).alias("max"))
        for c in cols], "name string, value double, trend double, trend_direction string, min double, max double")


def downsample(df: DataFrame, order_by: Sequence[str], points: int = 50) -> DataFrame:
    """Every (n // points)-th row of the order, missing values as 0."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    step = max(1, df.count() // points)
    kept = list(dict.fromkeys([*order_by, *cols]))
    indexed = with_row_index(df.select(*map(col, kept)), order_by)
    return indexed.filter(F.col("row_index") % step == 0).select(
        "row_index", *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed.

    A constant column gets a unit-wide range around its value. Infinite values
    count as missing, as no equal-width bin can hold them.
    """
    df = nan_to_null(df)
    cols = numeric_columns(df)
    schema = "column_name string, bin int, range string, count bigint, percentage double"
    if not cols:
        return one_row_to_long(df, [], schema)
    df = df.select(*[F.when(F.abs(col(c).cast("double")) < float("inf"), col(c).cast("double")).alias(c) for c in cols])
    ends = df.agg(*[f(col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols)
                    for p, f in (("a", F.min), ("z", F.max))]).first()
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"z{i}"]
        if low is None:
            low, high = 0.0, 1.0
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        edges = [low + b * width for b in range(bins)] + [high]
        v = col(c).cast("double")
        for b in range(bins):
            inside = (v >= edges[b]) & ((v <= edges[b + 1]) if b == bins - 1 else (v < edges[b + 1]))
            aggs.append(F.count_if(inside).alias(f"h{i}_{b}"))
            structs.append(F.struct(
                F.lit(c).alias("column_name"), F.lit(b).alias("bin"),
                F.lit(f"{edges[b]:.1f}-{edges[b + 1]:.1f}").alias("range"),
                F.col(f"h{i}_{b}").alias("count"),
                F.try_divide(F.col(f"h{i}_{b}") * 100.0, F.col("n")).alias("percentage")))
    return one_row_to_long(df.agg(*aggs), structs, schema)


def half_means(df: DataFrame, order_by: Sequence[str], cols: Sequence[str], n: int) -> DataFrame:
    """One row: number of rows, first and last value and the mean of each half of the order, without sorting the table."""
    key = row_key(df, order_by)
    middle = boundaries(df, key, [n // 2], n).get(n // 2) if n > 1 else None
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [(F.lit(None).cast("double") if middle is None else mean_before(col(c), key, middle)).alias(f"early{i}"),
                 (F.avg(col(c).cast("double")) if middle is None else mean_after(col(c), key, middle)).alias(f"late{i}"),
                 F.min_by(col(c), key).cast("double").alias(f"first{i}"), F.max_by(col(c), key).cast("double").alias(f"last{i}")]
    return df.agg(*aggs)


def growth_metrics(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Half-over-half growth and an annualized rate over rows taken as months."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    kept = list(dict.fromkeys([*order_by, *cols]))
    n = df.count()
    row = half_means(df.select(*map(col, kept)), order_by, cols, n).filter("n >= 2")
    exponent = 1.0 / max(1.0, n / 12)
    structs = []
    for i, c in enumerate(cols):
        early, late, first, last = (F.col(f"{p}{i}") for p in ("early", "late", "first", "last"))
        growth = F.when(early != 0, (late - early) / early * 100).otherwise(0.0)
        ratio = F.try_divide(last, first)
        cagr = F.when(first == 0, 0.0).when(ratio >= 0, (F.pow(ratio, F.lit(exponent)) - 1) * 100)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), growth.alias("growth_rate"), cagr.alias("cagr"),
            F.when(growth > 0, "accelerating").otherwise("decelerating").alias("momentum")))
    return one_row_to_long(row, structs, "column_name string, growth_rate double, cagr double, momentum string")


def risk_indicators(df: DataFrame, abs_cv: bool = False) -> DataFrame:
    """Volatility and outlier share per metric. The coefficient of variation is
    signed unless ``abs_cv`` is set."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"mean": cols, "std": cols, "outliers": cols}, bounds=bounds)
    structs = []
    for c in cols:
        cv = F.coalesce(s.cv(c) * 100, F.lit(0.0))
        cv = F.abs(cv) if abs_cv else cv
        share = F.try_divide(s("outliers", c) * 100.0, s.n)
        level = (F.when((cv > 50) | (share > 10), "high")
                 .when((cv > 25) | (share > 5), "medium").otherwise("low"))
        structs.append(F.struct(F.lit(c).alias("metric"), cv.alias("volatility"),
                                share.alias("outlier_percentage"), level.alias("risk_level")))
    return one_row_to_long(s.row, structs, "metric string, volatility double, outlier_percentage double, risk_level string")


def performance_score(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """0.3 completeness + 0.3 consistency + 0.4 growth, with a health label."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    if not cols:
        s = WideStats(df, {"missing": df.columns})
        return s.row.select(F.lit(0.0).alias("overall_score"), F.lit("unknown").alias("health"),
                            s.completeness(df.columns).alias("data_quality"), F.lit(None).cast("double").alias("consistency"),
                            F.lit(None).cast("double").alias("growth"))
    s = WideStats(df, {"missing": df.columns, "mean": cols, "std": cols,
                       "first": cols, "last": cols}, order_by)
    quality = s.completeness(df.columns)
    mean_cv = mean_of([s.cv(c) for c in cols])
    consistency = F.when(mean_cv.isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), 100 - mean_cv * 100))
    growth = F.coalesce(mean_of([
        F.when((s.n > 1) & (s("first", c) != 0), F.least(F.lit(100.0), F.greatest(
            F.lit(0.0), 50 + (s("last", c) - s("first", c)) / s("first", c) * 100)))
        for c in cols]), F.lit(50.0))
    row = s.row.select(quality.alias("data_quality"), consistency.alias("consistency"),
                       growth.alias("growth"))
    overall = F.col("data_quality") * 0.3 + F.col("consistency") * 0.3 + F.col("growth") * 0.4
    return row.select(
        overall.alias("overall_score"),
        F.when(overall >= 80, "excellent").when(overall >= 60, "good").when(overall >= 40, "fair")
        .otherwise("needs attention").alias("health"),
        "data_quality", "consistency", "growth")
