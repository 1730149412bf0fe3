"""Column families, long forms, first/last values and a distributed row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.session import materialize

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLOATING = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened where a column already has one (names are compared as Spark does, without case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (booleans are not numeric)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this package."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
        for c in df.columns
    ])


def as_text(df: DataFrame, name: str) -> Column:
    """Text form of a column for value counting; 0.0 and -0.0 are one value."""
    kind = df.schema[name].dataType
    if isinstance(kind, FLOATING):
        return (col(name) + F.lit(0.0)).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(col(name)))
    return col(name).cast("string")


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of (column_name, value) with every value as text."""
    texts = df.select(*[as_text(df, c).alias(c) for c in cols])
    return texts.unpivot([], [col(c) for c in cols], "column_name", "value")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over non-null values, empty without columns.

    Counts are combined before the shuffle, so a value held by a third of all
    rows arrives as one row per map task.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    return (
        long_values(df, cols)
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _family(kind: T.DataType) -> str:
    """Type in which a column's values are compared when counted."""
    if isinstance(kind, FLOATING):
        return "double"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "bigint"
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return "timestamp_ntz"
    if isinstance(kind, T.TimestampType):
        return "timestamp"
    return "string"


def column_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, distinct_count, value_count, top_count) over non-null values.

    Columns of one type are counted together, so numbers are never turned into
    text and a table needs a pass over each type's columns only. Columns
    without values are absent.
    """
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, distinct_count bigint, value_count bigint, top_count bigint")
    families: dict[str, list[str]] = {}
    for c in cols:
        families.setdefault(_family(df.schema[c].dataType), []).append(c)
    parts = []
    for kind, names in families.items():
        typed = df.select(*[(as_text(df, c) if kind == "string" else col(c).cast(kind)).alias(c) for c in names])
        parts.append(
            typed.unpivot([], [col(c) for c in names], "column_name", "value").filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column_name").agg(
                F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("value_count"), F.max("n").alias("top_count")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, distinct_count); columns without values are absent."""
    return column_counts(df, cols).select("column_name", "distinct_count")


def one_row_to_long(row: DataFrame, structs: Sequence[Column], schema: str) -> DataFrame:
    """Turn a one-row wide aggregate into one row per struct; without structs an empty frame of ``schema``."""
    if not structs:
        return row.sparkSession.createDataFrame([], schema)
    return row.select(F.inline(F.array(*structs)))


def order_key(order_by: Sequence[str]) -> Column:
    return F.struct(*[col(c) for c in order_by])


def first_value(name: str, order_by: Sequence[str]) -> Column:
    """Value in the first row of the order, as an aggregate (no sort, no window)."""
    return F.min_by(col(name), order_key(order_by))


def last_value(name: str, order_by: Sequence[str]) -> Column:
    return F.max_by(col(name), order_key(order_by))


def ordered_partitions(df: DataFrame, order_by: Sequence[str | Column], part: str, place: str) -> DataFrame:
    """The rows sorted across tasks by a range shuffle, with the number of their task and their 0-based place in it.

    The row's own input position is the last sort key, hence equal keys spread over several tasks instead of filling one.
    Count and use the places in one execution, or store the result first: the ranges come from a sample.
    """
    tie, = free_names([*df.columns, part, place], "_tie")
    keys = [*[col(c) if isinstance(c, str) else c for c in order_by], F.col(tie)]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
            .select(*[col(c) for c in df.columns], F.spark_partition_id().alias(part), within.alias(place)))


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], index: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the given order.

    A range shuffle sorts the rows across tasks; the sorted copy is written
    once, so that the per-partition counts and the rows they number come from
    the same data. The row's own input position is the last sort key, hence
    equal keys spread over several tasks instead of filling one.
    """
    part, pos, start = free_names([*df.columns, index], "_part", "_pos", "_start")
    own = [col(c) for c in df.columns]
    stored = materialize(ordered_partitions(df, order_by, part, pos), "row-index")
    # One row per shuffle partition, so this window and broadcast stay small.
    starts = stored.groupBy(part).agg(F.count(F.lit(1)).alias(start)).select(
        part,
        F.coalesce(
            F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias(start))
    return stored.join(F.broadcast(starts), part).select(*own, (col(start) + col(pos)).alias(index))
