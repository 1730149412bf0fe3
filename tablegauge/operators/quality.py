"""Data quality scores, findings and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    col, nan_to_null, numeric_columns, one_row_to_long, text_columns)
from tablegauge.functions.quantiles import iqr_bounds
from tablegauge.functions.wide import WideStats, numbered

# How findings and advice are worded.
MISSING_TEXT = "%s has %d missing values (%.1f%%)"
MISSING_ADVICE = "Consider imputation or data collection"
DUPLICATE_TEXT = "%d duplicate rows found"
DUPLICATE_ADVICE = "Review and remove duplicate records if not intentional"
OUTLIER_TEXT = "%d outliers detected in %s"
OUTLIER_ADVICE = "Investigate outliers for data entry errors or special cases"
TABLE_ADVICE = {
    "missing": "Address missing data through imputation or data collection",
    "duplicates": "Remove or investigate duplicate records",
    "numeric": "Consider including numeric columns for more advanced analysis",
    "samples": "Dataset may benefit from more samples for reliable analysis",
}

# Numeric columns with these names must not be negative.
NON_NEGATIVE_NAMES = ("age", "price", "revenue", "sales")


def _row_key(df: DataFrame) -> list[Column]:
    """Columns to group whole rows by: those of fixed width as they are, all others as two 64-bit hashes together.

    So a group key has the same few bytes however long the texts are. A null hashes like no value; a flag per column
    tells them apart.
    """
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    keys, wide = [], []
    for f in df.schema:
        if isinstance(f.dataType, fixed):
            keys.append(col(f.name).alias(f"k{len(keys)}"))
        else:
            value = F.to_json(F.struct(col(f.name))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name)
            wide += [value, col(f.name).isNull()]
    if wide:
        keys += [F.xxhash64(*wide).alias("h0"), F.xxhash64(F.lit(1), *wide).alias("h1")]
    return keys


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``n`` and the rows that repeat an earlier identical row.

    Copies are counted per task before the shuffle, so a row repeated a million
    times is moved once per task.
    """
    copies = nan_to_null(df).groupBy(*_row_key(df)).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0).cast("bigint")).alias("duplicate_rows"))


def completeness_score(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns})
    return s.row.select(s.completeness(df.columns).alias("completeness_score"))


def _unique_share(n: Column, duplicates: Column) -> Column:
    return F.coalesce((1 - F.try_divide(duplicates, n)) * 100, F.lit(100.0))


def consistency_score(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).select(
        "duplicate_rows", _unique_share(F.col("n"), F.col("duplicate_rows")).alias("consistency_score"))


def _with_duplicates(stats: DataFrame, df: DataFrame) -> DataFrame:
    """Add ``duplicate_rows`` to a one-row frame as a scalar subquery."""
    return stats.withColumn("duplicate_rows", duplicate_rows(df).select("duplicate_rows").scalar())


def overall_score(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns})
    row = _with_duplicates(s.row, df)
    overall = s.completeness(df.columns) * 0.6 + _unique_share(s.n, F.col("duplicate_rows")) * 0.4
    return row.select(F.round(overall, 2).alias("overall_score"))


def completeness_detail(df: DataFrame) -> DataFrame:
    """One row per column with missing values, with the table totals alongside."""
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns})
    return one_row_to_long(s.row, [
        F.struct(
            F.lit(c).alias("column_name"), s("missing", c).alias("missing_count"),
            F.round(F.try_divide(s("missing", c) * 100.0, s.n), 2).alias("missing_percentage"),
            s.total_missing(df.columns).alias("total_missing"),
            (s.n * len(df.columns)).alias("total_cells"),
            s.completeness(df.columns).alias("completeness_percentage"))
        for c in df.columns], "column_name string, missing_count bigint, missing_percentage double, total_missing bigint, "
                              "total_cells bigint, completeness_percentage double").filter("missing_count > 0")


def accuracy(df: DataFrame) -> DataFrame:
    """Outlier columns, and a score that loses ten points for each."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"outliers": cols}, bounds=bounds)
    issues = F.lit(0)
    for c in cols:
        issues = issues + (s("outliers", c) > 0).cast("int")
    return one_row_to_long(s.row, [
        F.struct(F.lit(c).alias("column_name"), s("outliers", c).alias("outlier_count"),
                 F.try_divide(s("outliers", c) * 100.0, s.n).alias("percentage"),
                 F.greatest(F.lit(0), 100 - issues * 10).alias("accuracy_score"))
        for c in cols], "column_name string, outlier_count bigint, percentage double, accuracy_score int").filter("outlier_count > 0")


def value_classes(df: DataFrame) -> DataFrame:
    """Per text column, how many values parse as which type.

    Spark columns hold one type, so mixed content shows in how text parses:
    int, float, date, bool or text; two or more classes mean ``mixed_types``.
    """
    cols = text_columns(df)

    def kind(c: str) -> Column:
        v = F.trim(col(c))
        return (F.when(v.isNull(), None)
                .when(v.rlike(r"^[+-]?[0-9]+$"), "int")
                .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float")
                .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
                .when(F.lower(v).isin("true", "false"), "bool")
                .otherwise("text"))

    kinds = ("int", "float", "date", "bool", "text")
    schema = f"column_name string, {', '.join(f'{k}_count bigint' for k in kinds)}, mixed_types boolean"
    if not cols:
        return one_row_to_long(df, [], schema)
    row = df.select(*[kind(c).alias(c) for c in cols]).agg(*[
        F.count_if(col(c) == k).alias(f"{k}{i}") for i, c in enumerate(cols) for k in kinds])
    structs = []
    for i, c in enumerate(cols):
        present = sum((F.col(f"{k}{i}") > 0).cast("int") for k in kinds)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), *[F.col(f"{k}{i}").alias(f"{k}_count") for k in kinds],
            (present > 1).alias("mixed_types")))
    return one_row_to_long(row, structs, schema)


def consistency_detail(df: DataFrame) -> DataFrame:
    n, d = F.col("n"), F.col("duplicate_rows")
    return duplicate_rows(df).select(
        d, F.round(F.coalesce(F.try_divide(d * 100.0, n), F.lit(0.0)), 2).alias("duplicate_percentage"),
        _unique_share(n, d).alias("consistency_score"))


def validity(df: DataFrame, names: Sequence[str] = NON_NEGATIVE_NAMES) -> DataFrame:
    """Negative values in columns that must not have them; 15 points per column."""
    df = nan_to_null(df)
    wanted = {n.lower() for n in names}
    cols = [c for c in numeric_columns(df) if c.lower() in wanted]
    s = WideStats(df, {"negative": cols})
    issues = F.lit(0)
    for c in cols:
        issues = issues + (s("negative", c) > 0).cast("int")
    return one_row_to_long(s.row, [
        F.struct(F.lit(c).alias("column_name"), F.lit("negative_values").alias("issue"),
                 s("negative", c).alias("count"),
                 F.greatest(F.lit(0), 100 - issues * 15).alias("validity_score"))
        for c in cols], "column_name string, issue string, count bigint, validity_score int").filter("count > 0")


def issues(df: DataFrame) -> DataFrame:
    """Missing data (high), duplicate rows and frequent outliers (medium)."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"missing": df.columns, "outliers": cols}, bounds=bounds)
    row = _with_duplicates(s.row, df)

    def finding(position, flag, severity, kind, column, count, description, advice):
        return F.struct(
            F.lit(position).alias("position"), flag.alias("flag"), F.lit(severity).alias("severity"),
            F.lit(kind).alias("type"), F.lit(column).cast("string").alias("column_name"),
            count.alias("count"), description.alias("description"), F.lit(advice).alias("recommendation"))

    found = [
        finding(i, s("missing", c) > s.n * 0.1, "high", "missing_data", c, s("missing", c),
                F.format_string(MISSING_TEXT, F.lit(c), s("missing", c), F.try_divide(s("missing", c) * 100.0, s.n)),
                MISSING_ADVICE)
        for i, c in enumerate(df.columns)]
    duplicates = F.col("duplicate_rows")
    found.append(finding(
        len(found), duplicates > 0, "medium", "duplicates", None, duplicates,
        F.format_string(DUPLICATE_TEXT, duplicates), DUPLICATE_ADVICE))
    found += [
        finding(len(df.columns) + 1 + i, s("outliers", c) > s.n * 0.05, "medium", "outliers", c,
                s("outliers", c), F.format_string(OUTLIER_TEXT, s("outliers", c), F.lit(c)), OUTLIER_ADVICE)
        for i, c in enumerate(cols)]
    return one_row_to_long(row, found, "flag boolean").filter("flag").drop("flag")


def quality_recommendations(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns})
    row = _with_duplicates(s.row, df)
    texts = [
        F.when(s.total_missing(df.columns) > 0, TABLE_ADVICE["missing"]),
        F.when(F.col("duplicate_rows") > 0, TABLE_ADVICE["duplicates"]),
        F.when(F.lit(not numeric_columns(df)), TABLE_ADVICE["numeric"]),
        F.when(s.n < 100, TABLE_ADVICE["samples"]),
    ]
    return numbered(row, texts)


def quality_report(df: DataFrame, names: Sequence[str] = NON_NEGATIVE_NAMES) -> DataFrame:
    """All of the above as (section, metric, column_name, value), one row per finding.

    Two passes for the statistics (quantiles, then counts) and one grouped pass
    for duplicate rows.
    """
    df = nan_to_null(df)
    cols = numeric_columns(df)
    wanted = {n.lower() for n in names}
    guarded = [c for c in cols if c.lower() in wanted]
    bounds, _ = iqr_bounds(df, cols)
    s = WideStats(df, {"missing": df.columns, "outliers": cols, "negative": guarded}, bounds=bounds)
    row = _with_duplicates(s.row, df)
    duplicates = F.col("duplicate_rows")
    complete, unique = s.completeness(df.columns), _unique_share(s.n, duplicates)

    def entry(section, metric, column, value, keep=F.lit(True)):
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        F.lit(column).cast("string").alias("column_name"),
                        value.cast("double").alias("value"), keep.alias("keep"))

    def flagged(stat, names_):
        total = F.lit(0)
        for c in names_:
            total = total + (s(stat, c) > 0).cast("int")
        return total

    rows = [
        entry("overall", "overall_score", None, F.round(complete * 0.6 + unique * 0.4, 2)),
        entry("completeness", "total_missing", None, s.total_missing(df.columns)),
        entry("completeness", "total_cells", None, s.n * len(df.columns)),
        entry("completeness", "completeness_percentage", None, complete),
        entry("accuracy", "accuracy_score", None, F.greatest(F.lit(0), 100 - flagged("outliers", cols) * 10)),
        entry("consistency", "duplicate_rows", None, duplicates),
        entry("consistency", "consistency_score", None, unique),
        entry("validity", "validity_score", None, F.greatest(F.lit(0), 100 - flagged("negative", guarded) * 15)),
    ]
    rows += [entry("completeness", "missing_count", c, s("missing", c), s("missing", c) > 0) for c in df.columns]
    rows += [entry("accuracy", "outliers", c, s("outliers", c), s("outliers", c) > 0) for c in cols]
    rows += [entry("validity", "negative_values", c, s("negative", c), s("negative", c) > 0) for c in guarded]
    rows += [entry("issues", "missing_data", c, s("missing", c), s("missing", c) > s.n * 0.1) for c in df.columns]
    rows += [entry("issues", "duplicates", None, duplicates, duplicates > 0)]
    rows += [entry("issues", "outliers", c, s("outliers", c), s("outliers", c) > s.n * 0.05) for c in cols]
    return one_row_to_long(row, rows, "keep boolean").filter("keep").drop("keep")


def quality_trend(reports: DataFrame, key: Sequence[str], at: str, score: str) -> DataFrame:
    """Score of each snapshot with its change against the one before.

    Ordered within each key; a history of reports has one row per snapshot.
    """
    w = Window.partitionBy(*key).orderBy(at)
    change = col(score) - F.lag(score).over(w)
    return reports.select(
        *key, at, score, change.alias("score_change"),
        F.when(change > 0, "improving").when(change < 0, "declining")
        .when(change.isNotNull(), "stable").alias("direction"))


def daily_completeness(df: DataFrame, at: str, cols: Sequence[str], unit: str = "day") -> DataFrame:
    """Completeness of the given columns per period, the input of a quality trend."""
    df = nan_to_null(df)
    missing = F.lit(0).cast("bigint")
    for c in cols:
        missing = missing + F.count_if(col(c).isNull())
    return df.groupBy(F.date_trunc(unit, at).cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("row_count"),
        ((1 - missing / (F.count(F.lit(1)) * len(cols))) * 100).alias("completeness"))
