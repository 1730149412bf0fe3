"""Gaps in a table: time, features, coverage, relationships, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    col, distinct_counts, nan_to_null, numeric_columns, one_row_to_long, temporal_columns)
from tablegauge.functions.wide import WideStats, names_where, numbered
from tablegauge.operators.insights import pair_correlations


# How gaps, their impact and what to do about them are worded.
SUGGESTIONS = {
    "temporal_dimension": "Consider adding date/time columns for trend analysis",
    "identifier": "Unique identifiers help with data tracking and joins",
    "numeric_features": "More numeric features enable correlation and predictive analysis",
    "categorical_features": "Categorical features help with segmentation and grouping",
}
IMPACTS = {
    "high_missing_data": "May affect analysis reliability",
    "low_diversity": "Limited variation may reduce analytical value",
    "small_sample_size": "Small sample size may limit statistical significance",
}
TABLE_ADVICE = {
    "temporal": "Add temporal dimension to enable time-series analysis and trend detection",
    "samples": "Consider collecting more samples for more reliable statistical analysis",
    "numeric": "Add more numeric features to enable advanced analytics and modeling",
    "missing": "Address missing data to improve data quality and completeness",
    "derived": "Explore feature interactions and create derived features for better insights",
}
RELATIONSHIP_ADVICE = {
    "unable": "Need at least 2 numeric columns for relationship analysis",
    "few": "Explore feature engineering for better predictive power",
    "enough": "Good relationship coverage",
}


def temporal_gaps(df: DataFrame) -> DataFrame:
    """Date columns, the whole-day span of the first one and the row count."""
    cols = temporal_columns(df)
    n = F.count(F.lit(1))
    names = F.lit(", ".join(cols)).alias("date_columns")
    if not cols:
        return df.agg(n.alias("total_periods")).select(
            F.lit(False).alias("has_temporal_data"), names,
            F.lit(None).cast("bigint").alias("time_span_days"), "total_periods")
    first = F.col(cols[0]).cast("timestamp_ntz")
    span = F.timestamp_diff("DAY", F.min(first), F.max(first))
    return df.agg(n.alias("total_periods"), span.alias("time_span_days")).select(
        F.lit(True).alias("has_temporal_data"), names, "time_span_days", "total_periods")


def feature_gaps(schemas: DataFrame) -> DataFrame:
    """Features missing from each table, judged from its column names and types.

    ``schemas`` has one row per column: table_name, column_name, kind
    ('numeric' or other), value_count, row_count. A column without values is no feature;
    in an empty table every column counts.
    """
    name = F.lower("column_name")
    known = schemas.filter((F.col("value_count") > 0) | (F.col("row_count") == 0))
    flags = known.groupBy("table_name").agg(
        F.bool_or(name.contains("date") | name.contains("time")).alias("has_time"),
        F.bool_or(name.contains("id") | name.contains("key")).alias("has_id"),
        F.count_if(F.col("kind") == "numeric").alias("numeric"),
        F.count_if(F.col("kind") != "numeric").alias("other"))
    rules = [
        ("temporal_dimension", ~F.col("has_time")), ("identifier", ~F.col("has_id")),
        ("numeric_features", F.col("numeric") < 2), ("categorical_features", F.col("other") == 0)]
    gaps = names_where(rules)
    suggestions = names_where([(SUGGESTIONS[name], missing) for name, missing in rules])
    return flags.select(
        "table_name", F.array_join(gaps, ", ").alias("identified_gaps"),
        F.array_join(suggestions, "; ").alias("suggestions"), F.size(gaps).alias("gap_count"),
        F.when(F.size(gaps) >= 2, "high").otherwise("medium").alias("severity"))


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of several tables with their kind and number of values, the
    input of ``feature_gaps``: one aggregate per table."""
    parts = []
    for name, df in tables.items():
        numeric = set(numeric_columns(df))
        row = nan_to_null(df).agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
        parts.append(one_row_to_long(row, [
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                     F.lit("numeric" if c in numeric else "other").alias("kind"),
                     F.col(f"c{i}").alias("value_count"), F.col("n").alias("row_count"))
            for i, c in enumerate(df.columns)], "table_name string, column_name string, kind string, value_count bigint, row_count bigint"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def coverage_gaps(df: DataFrame) -> DataFrame:
    """Columns with much missing data or little variation, and small samples."""
    df = nan_to_null(df)
    s = WideStats(df, {"missing": df.columns})
    # Distinct counts come as one map, one entry per column.
    counted = distinct_counts(df, df.columns).agg(F.map_from_entries(
        F.collect_list(F.struct("column_name", "distinct_count"))).alias("m"))
    row = s.row.withColumn("m", counted.scalar())

    def distinct(c: str) -> Column:
        return F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0))

    sparse = names_where([(c, s("missing", c) > s.n * 0.2) for c in df.columns])
    flat = names_where([(c, (distinct(c) < 3) & (s.n > 10)) for c in df.columns])

    def gap(kind: str, flag: Column, columns: Column, samples: Column = F.lit(None)) -> Column:
        return F.when(flag, F.struct(F.lit(kind).alias("type"), columns.alias("columns"), F.lit(IMPACTS[kind]).alias("impact"),
                                     samples.cast("bigint").alias("sample_count")))

    found = row.select(F.filter(F.array(
        gap("high_missing_data", F.size(sparse) > 0, F.array_join(sparse, ", ")),
        gap("low_diversity", F.size(flat) > 0, F.array_join(flat, ", ")),
        gap("small_sample_size", s.n < 50, F.lit(""), s.n)), lambda g: g.isNotNull()).alias("gaps"))
    severity = (F.when(F.size("gaps") >= 2, "high").when(F.size("gaps") == 1, "medium").otherwise("low"))
    return found.select(severity.alias("severity"), F.inline_outer("gaps"))


def relationship_gaps(df: DataFrame) -> DataFrame:
    """How many pairs correlate strongly without being identical."""
    size = F.abs("correlation")
    strong = F.count_if((size > 0.7) & (size < 1.0))
    able = len(numeric_columns(df)) >= 2
    return pair_correlations(df).agg(strong.alias("strong_relationships_found")).select(
        F.lit(able).alias("can_analyze_relationships"), "strong_relationships_found",
        F.when(F.lit(not able), RELATIONSHIP_ADVICE["unable"])
        .when(F.col("strong_relationships_found") < 3,
              RELATIONSHIP_ADVICE["few"])
        .otherwise(RELATIONSHIP_ADVICE["enough"]).alias("recommendation"))


def diversity(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    listed = n.select(F.col("n"), F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column_name"))
    ratio = F.coalesce(F.try_divide("unique_values", "n"), F.lit(0.0))
    return (
        listed.join(distinct_counts(df, df.columns), "column_name", "left")
        .withColumn("unique_values", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
        .select("column_name", "unique_values", F.round(ratio, 3).alias("diversity_ratio"),
                F.when(ratio > 0.8, "high").when(ratio > 0.3, "medium").otherwise("low").alias("assessment")))


def gap_recommendations(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    numeric = len(numeric_columns(df))
    s = WideStats(df, {"missing": df.columns})
    return numbered(s.row, [
        F.when(F.lit(not temporal_columns(df)), TABLE_ADVICE["temporal"]),
        F.when(s.n < 100, TABLE_ADVICE["samples"]),
        F.when(F.lit(numeric < 3), TABLE_ADVICE["numeric"]),
        F.when(s.total_missing(df.columns) > 0, TABLE_ADVICE["missing"]),
        F.when(F.lit(numeric >= 2), TABLE_ADVICE["derived"]),
    ])


def missing_periods(df: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    """Periods between the first and the last one that have no rows."""
    found = df.select(F.date_trunc(unit, col(ts)).cast("timestamp_ntz").alias("period")).distinct()
    ends = found.agg(F.min("period").alias("a"), F.max("period").alias("z")).first()
    if ends["a"] is None:
        return found
    # The calendar is a distributed range, however long it is.
    span = df.sparkSession.range(1).select(F.timestamp_diff(unit.upper(), F.lit(ends["a"]), F.lit(ends["z"])).alias("n")).first()["n"]
    spine = df.sparkSession.range(span + 1).select(F.timestamp_add(
        unit.upper(), F.col("id").cast("int"), F.lit(ends["a"]).cast("timestamp_ntz")).alias("period"))
    return spine.join(found, "period", "left_anti")
