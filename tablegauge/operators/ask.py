"""Statistics behind questions asked about a table, and the questions themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    col, nan_to_null, non_numeric_columns, numeric_columns, one_row_to_long, ordered_partitions)
from tablegauge.functions.quantiles import exact_quantiles, iqr_bounds
from tablegauge.functions.wide import WideStats, mean_of, names_where, numbered
from tablegauge.operators.insights import half_means, pair_correlations, percent_change
from tablegauge.operators.quality import _unique_share, _with_duplicates

# The intents in order of precedence and the words that show them.
INTENT_WORDS = {
    "overview": ("overview", "summary", "describe", "tell me about", "what is this"),
    "statistics": ("mean", "average", "median", "max", "min", "sum", "total", "count"),
    "trends": ("trend", "pattern", "over time", "growing", "declining", "increasing", "decreasing"),
    "comparison": ("compare", "difference", "between", "vs", "versus", "higher", "lower"),
    "insights": ("insight", "finding", "discover", "what should i know", "key takeaway"),
    "recommendations": ("recommend", "suggest", "what should i", "next step", "action"),
    "quality": ("quality", "missing", "null", "complete", "clean", "issue"),
    "prediction": ("predict", "forecast", "future", "will", "expect"),
    "correlation": ("correlation", "relationship", "related", "connected", "affect"),
}


# How advice is worded.
ADVICE = {
    "missing": "Address missing values in %s",
    "complete": "Your data quality is good!",
    "falling": "Monitor declining metrics: %s",
    "rising": "Metrics show positive momentum!",
    "outliers": "Investigate outliers in %s",
    "models": "Consider building predictive models or generating detailed insights",
    "charts": "Create charts to visualize trends and patterns",
}


def classify_intent(df: DataFrame, text: str) -> DataFrame:
    """Add ``intent``: the first list with a word contained in the text."""
    lowered = F.lower(text)
    intent = F
    for name, words in INTENT_WORDS.items():
        hit = lowered.contains(words[0])
        for w in words[1:]:
            hit = hit | lowered.contains(w)
        intent = intent.when(hit, name)
    return df.withColumn("intent", intent.otherwise("general"))


def match_columns(questions: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Add ``matched_column``: the first column, in schema order, named in the text."""
    lowered = F.lower(text)
    hits = [F.when(lowered.contains(c.lower()), F.lit(c)) for c in columns] or [F.lit(None).cast("string")]
    return questions.withColumn("matched_column", F.coalesce(*hits))


def answer_statistics(questions: DataFrame, text: str, df: DataFrame) -> DataFrame:
    """Each question with the statistics of the numeric column it names; NULLs if it names none."""
    return match_columns(questions, text, numeric_columns(df)).join(
        column_statistics(df).withColumnRenamed("column_name", "matched_column"), "matched_column", "left")


def overview(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    cols = numeric_columns(df)
    s = WideStats(df, {"missing": df.columns, "mean": cols, "min": cols, "max": cols})
    shared = [s.n.alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
              F.lit(len(cols)).alias("numeric_count"),
              F.lit(len(non_numeric_columns(df))).alias("categorical_count"),
              s.completeness(df.columns).alias("completeness")]
    return one_row_to_long(s.row, [
        F.struct(*shared, F.lit(c).alias("column_name"), s("mean", c).alias("mean"),
                 s("min", c).alias("min"), s("max", c).alias("max"))
        for c in cols] or [F.struct(*shared, F.lit(None).cast("string").alias("column_name"), *[
            F.lit(None).cast("double").alias(x) for x in ("mean", "min", "max")])], "")


def column_statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, quartiles, spread, volatility band and outliers of each column."""
    df = nan_to_null(df)
    cols = list(cols or numeric_columns(df))
    bounds, q = iqr_bounds(df, cols, probs=(0.25, 0.5, 0.75))
    s = WideStats(df, {"mean": cols, "std": cols, "min": cols, "max": cols, "outliers": cols}, bounds=bounds)
    structs = []
    for c in cols:
        cv = F.coalesce(s.cv(c) * 100, F.lit(0.0))
        structs.append(F.struct(
            F.lit(c).alias("column_name"), s("mean", c).alias("mean"),
            F.lit(q[c][1]).cast("double").alias("median"), s("std", c).alias("std"),
            s("min", c).alias("min"), s("max", c).alias("max"),
            F.lit(q[c][0]).cast("double").alias("q25"), F.lit(q[c][2]).cast("double").alias("q75"),
            cv.alias("cv"),
            F.when(cv > 50, "high").when(cv > 25, "moderate").otherwise("low").alias("volatility"),
            s("outliers", c).alias("outlier_count")))
    return one_row_to_long(
        s.row, structs, "column_name string, mean double, median double, std double, min double, max double, q25 double, "
                        "q75 double, cv double, volatility string, outlier_count bigint")


def trend_bands(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Change with a stable band of five percent, and half-over-half momentum."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    kept = list(dict.fromkeys([*order_by, *cols]))
    row = half_means(df.select(*map(col, kept)), order_by, cols, df.count()).filter("n > 1")
    structs = []
    for i, c in enumerate(cols):
        change = percent_change(F.col(f"first{i}"), F.col(f"last{i}"), F.col("n"))
        structs.append(F.struct(
            F.lit(c).alias("column_name"), change.alias("change_percent"),
            F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")
            .alias("direction"),
            F.when(F.col(f"late{i}") > F.col(f"early{i}"), "accelerating").otherwise("decelerating")
            .alias("momentum")))
    return one_row_to_long(row, structs, "column_name string, change_percent double, direction string, momentum string")


def skew_comparison(df: DataFrame) -> DataFrame:
    """Mean against median of every numeric column, and its mean over the next column's (over the first's for the last)."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    q = exact_quantiles(df, cols, [0.5])
    s = WideStats(df, {"mean": cols})
    structs = []
    for c, other in zip(cols, [*cols[1:], *cols[:1]]):
        ratio = F.coalesce(F.try_divide(s("mean", c), s("mean", other)), F.lit(0.0))
        median = F.lit(q[c][0]).cast("double")
        gap = F.when(median != 0, (s("mean", c) - median) / median * 100).otherwise(0.0)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), s("mean", c).alias("mean"), median.alias("median"),
            F.when(gap > 10, "right-skewed").when(gap < -10, "left-skewed").otherwise("balanced").alias("skew"),
            F.lit(other).alias("other_column"), ratio.alias("mean_ratio")))
    return one_row_to_long(s.row, structs, "column_name string, mean double, median double, skew string, "
                                           "other_column string, mean_ratio double")


def quick_insights(df: DataFrame) -> DataFrame:
    """Missing share, strongest pair, most volatile and most stable column."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    s = WideStats(df, {"missing": df.columns, "mean": cols, "std": cols})
    r = F.col("correlation")
    # Perfect positive pairs are left out, as they repeat one column.
    pair = pair_correlations(df).filter(r < 1.0).agg(F.max_by(
        F.struct("column1", "column2", "correlation"),
        F.struct(F.abs(r), -F.col("pair_position"))).alias("p")).scalar()
    def spreads(sign: int) -> Column:
        found = F.array(*[F.struct((s.cv(c) * 100).alias("cv"), F.lit(sign * i).alias("rank"), F.lit(c).alias("name"))
                          for i, c in enumerate(cols)])
        return F.filter(found.cast("array<struct<cv: double, rank: int, name: string>>"), lambda x: x["cv"].isNotNull())

    # Ties go to the earlier column at both ends.
    cvs, low = spreads(-1), spreads(1)
    missing = 100 - s.completeness(df.columns)
    row = s.row.select(missing.alias("missing_percent"), pair.alias("p"),
                       F.array_max(cvs).alias("hi"), F.array_min(low).alias("lo"))
    size = F.abs(F.col("p.correlation"))
    return row.select(
        "missing_percent",
        F.when(F.col("missing_percent") > 5, "incomplete").otherwise("excellent").alias("data_quality"),
        F.col("p.column1").alias("column1"), F.col("p.column2").alias("column2"),
        F.col("p.correlation").alias("correlation"),
        F.when(size > 0.7, "strong").when(size > 0.5, "moderate").when(size.isNotNull(), "weak").alias("strength"),
        F.col("hi.name").alias("most_volatile"), F.col("hi.cv").alias("most_volatile_cv"),
        F.col("lo.name").alias("most_stable"), F.col("lo.cv").alias("most_stable_cv"))


def advice(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Missing data, declining metrics and frequent outliers, as numbered advice."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"missing": df.columns, "first": cols, "last": cols, "outliers": cols},
                  order_by, bounds)
    sparse = names_where([(c, s("missing", c) > s.n * 0.1) for c in df.columns])
    falling = names_where([(c, s("last", c) < s("first", c)) for c in cols])
    noisy = names_where([(c, s("outliers", c) > s.n * 0.05) for c in cols])
    return numbered(s.row, [
        F.when(F.size(sparse) > 0, F.format_string(ADVICE["missing"], F.array_join(sparse, ", "))).otherwise(ADVICE["complete"]),
        F.when((s.n > 1) & F.lit(bool(cols)), F.when(F.size(falling) > 0, F.format_string(
            ADVICE["falling"], F.array_join(falling, ", "))).otherwise(ADVICE["rising"])),
        F.when(F.size(noisy) > 0, F.format_string(ADVICE["outliers"], F.array_join(noisy, ", "))),
        F.lit(ADVICE["models"]),
        F.lit(ADVICE["charts"]),
    ])


def quality_assessment(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    cols = numeric_columns(df)
    s = WideStats(df, {"missing": df.columns, "mean": cols, "std": cols})
    row = _with_duplicates(s.row, df)
    affected = F.lit(0)
    for c in df.columns:
        affected = affected + (s("missing", c) > 0).cast("int")
    complete = s.completeness(df.columns)
    cv = F.coalesce(mean_of([s.cv(c) for c in cols]), F.lit(0.0))
    return row.select(
        complete.alias("completeness"), affected.alias("columns_with_missing"),
        F.col("duplicate_rows"), cv.alias("average_cv"),
        F.when(cv < 0.5, "High").when(cv < 1, "Moderate").otherwise("Low").alias("consistency"),
        (complete * 0.6 + _unique_share(s.n, F.col("duplicate_rows")) * 0.4).alias("overall_score"))


def linear_projection(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Least-squares slope over the row index and the value it implies next."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    kept = list(dict.fromkeys([*order_by, *cols]))
    # Sums per sorted partition with places from its beginning, in one pass; what comes before is added to them after.
    at, part = F.col("_at").cast("double"), F.col("_part")
    placed = ordered_partitions(df.select(*map(col, kept)), order_by, "_part", "_at")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        y = col(c).cast("double")
        x = F.when(y.isNotNull(), at)
        aggs += [F.count(y).alias(f"k{i}"), F.sum(y).alias(f"y{i}"), F.sum(x).alias(f"x{i}"), F.sum(x * x).alias(f"xx{i}"),
                 F.sum(x * y).alias(f"xy{i}"), F.max_by(y, "_at").alias(f"last{i}")]
    # One row per shuffle partition from here on.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("_part").agg(*aggs).withColumn("d", before - (F.lit(df.count()) - 1) / 2)
    d, aggs = F.col("d"), [F.sum("n").alias("n")]
    for i in range(len(cols)):
        k, x, y, xx, xy = (F.col(f"{v}{i}") for v in ("k", "x", "y", "xx", "xy"))
        n, sx, sy = F.sum(k), F.sum(x + k * d), F.sum(y)
        rise, run = F.sum(xy + d * y) - sx * F.try_divide(sy, n), F.sum(xx + 2 * d * x + k * d * d) - sx * F.try_divide(sx, n)
        aggs += [F.try_divide(rise, F.when(n > 1, run)).alias(f"slope{i}"), F.max_by(f"last{i}", "_part").alias(f"last{i}")]
    structs = []
    for i, c in enumerate(cols):
        slope, last = F.col(f"slope{i}"), F.col(f"last{i}")
        structs.append(F.struct(
            F.lit(c).alias("column_name"), slope.alias("slope"), (last + slope).alias("next_value"),
            F.when(last != 0, slope / last * 100).otherwise(0.0).alias("change_percent"),
            F.when(slope > 0, "increase").otherwise("decrease").alias("direction")))
    return one_row_to_long(sums.agg(*aggs).filter("n > 1"), structs,
                           "column_name string, slope double, next_value double, change_percent double, direction string")


def correlation_list(df: DataFrame) -> DataFrame:
    """All strong pairs in column order, with strength and direction."""
    r = F.col("correlation")
    size: Column = F.abs(r)
    return (
        pair_correlations(df).filter(size > 0.5).orderBy("pair_position")
        .select("column1", "column2", "correlation",
                F.when(size > 0.8, "very strong").when(size > 0.7, "strong").otherwise("moderate")
                .alias("strength"),
                F.when(r > 0, "positive").otherwise("negative").alias("direction")))
