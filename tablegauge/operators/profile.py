"""Table profiles, their snapshots and the texts made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    col, column_counts, distinct_counts, nan_to_null, numeric_columns, one_row_to_long,
    temporal_columns, text_columns, value_counts)
from tablegauge.functions.quantiles import exact_quantiles

PROFILE_SCHEMA = ("ordinal_position int, column_name string, data_type string, nullable boolean, total_rows bigint, null_count bigint, "
                  "null_fraction double, distinct_count bigint, min double, max double, avg double")


def profile_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, nulls, distinct values, and min/max/avg if numeric.

    One wide aggregate for everything but the exact distinct counts, which take
    one more pass over (column, value) counts; ``approx`` drops that pass.
    """
    df = nan_to_null(df)
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema):
        c, numeric = field.name, isinstance(field.dataType, T.NumericType)
        aggs.append(F.count(col(c)).alias(f"c{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(col(c)).alias(f"d{i}"))
        if numeric:
            aggs += [F.min(col(c)).cast("double").alias(f"lo{i}"),
                     F.max(col(c)).cast("double").alias(f"hi{i}"), F.avg(col(c)).alias(f"av{i}")]
        none = F.lit(None).cast("double")
        missing = F.col("n") - F.col(f"c{i}")
        structs.append(F.struct(
            F.lit(i + 1).alias("ordinal_position"), F.lit(c).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(field.nullable).alias("nullable"), F.col("n").alias("total_rows"),
            missing.alias("null_count"),
            F.round(F.coalesce(F.try_divide(missing, F.col("n")), F.lit(0.0)), 4).alias("null_fraction"),
            (F.col(f"d{i}") if approx else F.lit(None).cast("bigint")).alias("distinct_count"),
            (F.col(f"lo{i}") if numeric else none).alias("min"),
            (F.col(f"hi{i}") if numeric else none).alias("max"),
            (F.col(f"av{i}") if numeric else none).alias("avg")))
    profile = one_row_to_long(df.agg(*aggs), structs, PROFILE_SCHEMA)
    if approx:
        return profile
    found = distinct_counts(df, df.columns).withColumnRenamed("distinct_count", "_d")
    return (profile.join(found, "column_name", "left")
            .withColumn("distinct_count", F.coalesce("_d", F.lit(0).cast("bigint")))
            .select(*profile.columns))


def table_summary(df: DataFrame) -> DataFrame:
    """Type, distinct values and numeric statistics of each column."""
    df = nan_to_null(df)
    found = distinct_counts(df, df.columns)
    numeric = set(numeric_columns(df))
    aggs, structs = [], []
    for i, field in enumerate(df.schema):
        c = field.name
        if c in numeric:
            aggs += [F.min(col(c)).cast("double").alias(f"lo{i}"), F.max(col(c)).cast("double").alias(f"hi{i}"),
                     F.avg(col(c)).alias(f"av{i}"), F.count(col(c)).alias(f"n{i}")]
        none = F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"),
            (F.col(f"lo{i}") if c in numeric else none).alias("min"),
            (F.col(f"hi{i}") if c in numeric else none).alias("max"),
            (F.col(f"av{i}") if c in numeric else none).alias("avg"),
            (F.col(f"n{i}") if c in numeric else F.lit(None).cast("bigint")).alias("value_count")))
    row = df.agg(*(aggs or [F.count(F.lit(1)).alias("n")]))
    return one_row_to_long(row, structs, "column_name string, data_type string, min double, max double, avg double, "
                                         "value_count bigint").join(found, "column_name", "left").select(
        "column_name", "data_type", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
        "min", "max", "avg", "value_count")


def top_values(df: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` most frequent values of every text column, next to its number of distinct values.

    Each task keeps its ``top`` first before they are shuffled (Spark's window group limit).
    """
    counts = value_counts(df, text_columns(df))
    position = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value"))
    listed = counts.withColumn("position", position).filter(F.col("position") <= top)
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return listed.join(sizes, "column_name").select(
        "column_name", "position", "value", F.col("n").alias("count"), "distinct_count")


def profile_with_top_values(df: DataFrame, top: int = 50) -> DataFrame:
    """The full profile: one row per column with its top values as an array."""
    tops = top_values(df, top).groupBy("column_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value", "count"))),
            lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))
    return profile_table(df).join(tops, "column_name", "left")


def profile_columns(df: DataFrame) -> DataFrame:
    """Extended profile: uniqueness, spread, median and the share of the top value."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    quantiles = exact_quantiles(df, cols, [0.5])
    row = df.agg(*([F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(cols)] or [F.lit(1).alias("one")]))
    number = [F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("stddev"),
                       F.lit(quantiles[c][0]).cast("double").alias("median")) for i, c in enumerate(cols)]
    frequent = column_counts(df, df.columns)
    n = df.agg(F.count(F.lit(1)).alias("total_rows"))
    base = one_row_to_long(n, [
        F.struct(F.lit(c).alias("column_name"), F.col("total_rows")) for c in df.columns], "column_name string, total_rows bigint")
    result = base.join(frequent, "column_name", "left")
    if number:
        result = result.join(one_row_to_long(row, number, ""), "column_name", "left")
    else:
        result = result.withColumn("stddev", F.lit(None).cast("double")).withColumn(
            "median", F.lit(None).cast("double"))
    return result.select(
        "column_name", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
        F.try_divide(F.coalesce("distinct_count", F.lit(0)), F.col("total_rows")).alias("uniqueness_fraction"),
        "stddev", "median",
        F.try_divide(F.col("top_count"), F.col("total_rows")).alias("top_fraction"))


def string_profile(df: DataFrame) -> DataFrame:
    cols = text_columns(df)
    schema = "column_name string, min_length bigint, max_length bigint, avg_length double"
    if not cols:
        return one_row_to_long(df, [], schema)
    aggs = [f(F.length(col(c))).alias(f"{p}{i}") for i, c in enumerate(cols)
            for p, f in (("a", F.min), ("z", F.max), ("m", F.avg))]
    return one_row_to_long(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").cast("bigint").alias("min_length"),
                 F.col(f"z{i}").cast("bigint").alias("max_length"), F.col(f"m{i}").alias("avg_length"))
        for i, c in enumerate(cols)], schema)


def temporal_profile(df: DataFrame) -> DataFrame:
    cols = temporal_columns(df)
    schema = "column_name string, earliest string, latest string"
    if not cols:
        return one_row_to_long(df, [], schema)
    aggs = [f(col(c)).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("a", F.min), ("z", F.max))]
    stamp = "yyyy-MM-dd HH:mm:ss"
    return one_row_to_long(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column_name"), F.date_format(f"a{i}", stamp).alias("earliest"),
                 F.date_format(f"z{i}", stamp).alias("latest"))
        for i, c in enumerate(cols)], schema)


def append_profile(df: DataFrame, table: str, path: str, computed_at: str,
                   sample_size: int | None = None, sample_method: str = "full",
                   version: int = 1) -> DataFrame:
    """Profile ``df`` and append the rows to the snapshot table at ``path``,
    which is partitioned by day."""
    stamped = (
        profile_table(df)
        .withColumn("table_name", F.lit(table))
        .withColumn("sample_size", F.coalesce(F.lit(sample_size).cast("bigint"), F.col("total_rows")))
        .withColumn("sample_method", F.lit(sample_method))
        .withColumn("version", F.lit(version))
        .withColumn("computed_at", F.lit(computed_at).cast("timestamp_ntz"))
        .withColumn("computed_date", F.to_date("computed_at")))
    stamped.write.mode("append").partitionBy("computed_date").parquet(path)
    return df.sparkSession.read.parquet(path)


def latest_profiles(snapshots: DataFrame, key: Sequence[str] = ("table_name", "column_name"),
                    at: str = "computed_at") -> DataFrame:
    """Newest snapshot row per key, kept as one struct so no window is needed."""
    rest = [c for c in snapshots.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at]))
    return snapshots.groupBy(*key).agg(newest.alias("_r")).select(*key, "_r.*")


def profile_history(snapshots: DataFrame, table: str, column: str) -> DataFrame:
    return snapshots.filter((F.col("table_name") == table) & (F.col("column_name") == column)).orderBy(
        F.col("computed_at").desc())


def profile_drift(snapshots: DataFrame, key: Sequence[str] = ("column_name",),
                  at: str = "computed_at",
                  measures: Sequence[str] = ("null_fraction", "distinct_count", "avg")) -> DataFrame:
    """Change of each measure against the previous snapshot of the same column."""
    w = Window.partitionBy(*key).orderBy(at)
    return snapshots.select(*key, at, *measures, *[
        (col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in measures])


def profile_schema(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    """Profiles of several tables in one long table."""
    parts = [profile_table(df, approx).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def plain_number(x: Column) -> Column:
    """A double as text without an exponent, at least one decimal."""
    size = F.abs(x)
    digits = F.when(size >= 1e7, F.format_string("%.6f", x)).otherwise(F.format_string("%.12f", x))
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), x.cast("string")).otherwise(
        F.regexp_replace(digits, r"(\.\d+?)0+$", "$1"))


def schema_summary(profile: DataFrame, schema: str, table_column: str = "table_name") -> DataFrame:
    """Profile rows as one readable text per table."""
    p = F.col
    line = F.concat(
        F.lit("  • "), p("column_name"), F.lit(" ("), p("data_type"), F.lit(")"),
        F.when(p("null_fraction") > 0, F.format_string(" - %.1f%% null", p("null_fraction") * 100)).otherwise(""),
        F.when(p("min").isNotNull() & p("max").isNotNull(), F.concat(
            F.lit(" - Range: ["), plain_number(p("min")), F.lit(", "), plain_number(p("max")), F.lit("]"))).otherwise(""),
        F.when(p("avg").isNotNull(), F.format_string(" - Avg: %.2f", p("avg"))).otherwise(""),
        F.when(p("distinct_count") > 0, F.concat(
            F.lit(" - Distinct: "), F.format_number("distinct_count", 0))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("line")))),
                        lambda s: s["line"])
    return profile.groupBy(table_column).agg(
        F.max("total_rows").alias("n"), F.count(F.lit(1)).alias("k"), lines.alias("lines")).select(
        table_column,
        F.concat(
            F.lit(f"**Table: {schema}."), p(table_column), F.lit("**\n- Total Rows: "), F.format_number("n", 0),
            F.lit("\n- Column Count: "), p("k").cast("string"), F.lit("\n\nColumns:\n"),
            F.array_join("lines", "\n"), F.lit("\n")).alias("summary"))


def table_inventory(tables: Mapping[str, tuple[str, str, DataFrame]]) -> DataFrame:
    """Tables with kind and counted rows, plus the number of tables per schema.

    ``tables`` maps a table name to (schema, kind, frame).
    """
    hidden = {"information_schema", "pg_catalog"}
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"),
            F.lit(kind).alias("kind"), "row_count")
        for name, (schema, kind, df) in tables.items() if schema not in hidden]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    # One row per table of the catalog, so the window is small.
    return result.withColumn(
        "tables_in_schema", F.count(F.lit(1)).over(Window.partitionBy("schema_name")))


def column_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of several tables with type, nullability, nulls and distinct values."""
    return profile_schema(tables).select(
        "table_name", "column_name", "ordinal_position", "data_type", "null_count", "distinct_count")
