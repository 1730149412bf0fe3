"""Profiles that grow with the table: what a partition holds is kept as mergeable state, and only new partitions are read.

A state row per column holds exact parts (rows, values, sum, spread, extremes, lengths) and two sketches: HyperLogLog for
the number of distinct values and KLL for quantiles. States of partitions merge into the state of their union: exact parts
to the same numbers, sketches within the bounds they would have on the whole table. Profiles and drift read states only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import as_text, col, free_names, nan_to_null, one_row_to_long

HLL_BITS = 14  # relative standard error of about 1.04 / sqrt(2^14), 0.8 %
KLL_SIZE = 400  # rank error under 1 %
STATE = ("ordinal_position int, column_name string, data_type string, total_rows bigint, value_count bigint, mean double, "
         "spread double, min double, max double, min_text string, max_text string, length_sum bigint, min_length int, "
         "max_length int, distinct_sketch binary, quantile_sketch binary")
RANK_ERROR, DISTINCT_ERROR = 0.02, 0.04  # what merged sketches stay within, with room for their spread


def profile_state(df: DataFrame) -> DataFrame:
    """One state row per column of ``df``, from one aggregate over it.

    ``mean`` and ``spread`` (sum of squared deviations), ``min``, ``max`` and the quantile sketch are of numeric columns,
    the texts and lengths of the others, which count as text. NaN is missing. An empty table gives rows without values.
    """
    df = nan_to_null(df)
    row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(_column_states(df, df.columns))])
    return one_row_to_long(row, [F.col(f"p{i}") for i in range(len(df.columns))], STATE)


def _column_states(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    no = lambda kind: F.lit(None).cast(kind)
    states = []
    for i, c in enumerate(cols):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        number, text = col(c).cast("double"), as_text(df, c)
        size = F.length(text)
        states.append(F.struct(
            F.lit(i + 1).alias("ordinal_position"), F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"), F.count(F.lit(1)).alias("total_rows"),
            F.count(col(c)).alias("value_count"), (F.avg(number) if numeric else no("double")).alias("mean"),
            (F.coalesce(F.var_pop(number) * F.count(number), F.lit(0.0)) if numeric else no("double")).alias("spread"),
            (F.min(number) if numeric else no("double")).alias("min"), (F.max(number) if numeric else no("double")).alias("max"),
            (no("string") if numeric else F.min(text)).alias("min_text"), (no("string") if numeric else F.max(text)).alias("max_text"),
            (no("bigint") if numeric else F.sum(size)).alias("length_sum"), (no("int") if numeric else F.min(size)).alias("min_length"),
            (no("int") if numeric else F.max(size)).alias("max_length"),
            F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)) if numeric else no("binary")).alias("quantile_sketch")))
    return states


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """One state row per column (and per value of ``keys``) from any number of them.

    Counts and sums add up; means and spreads are combined around the common mean, so no digits are lost to large values.
    """
    groups = [*keys, "column_name"]
    n, m = F.col("value_count"), F.col("mean")
    total, mean = F.sum(n), F.try_divide(F.sum(F.when(n > 0, n * m)), F.sum(F.when(m.isNotNull(), n)))
    # Deviations from the mean of one of the parts, which is near enough to the common one.
    near = states.groupBy(*groups).agg(F.min("mean").alias("_near"))
    d = m - F.col("_near")
    numbers = F.sum(F.when(m.isNotNull(), n))
    spread = F.sum("spread") + F.sum(n * d * d) - F.try_divide(F.sum(n * d) * F.sum(n * d), numbers)
    merged = states.join(near, groups).groupBy(*groups).agg(
        F.min("ordinal_position").alias("ordinal_position"), F.max_by("data_type", "total_rows").alias("data_type"),
        F.sum("total_rows").alias("total_rows"), total.alias("value_count"), mean.alias("mean"),
        F.greatest(spread, F.sum("spread")).alias("spread"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"), F.sum("length_sum").alias("length_sum"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.hll_union_agg("distinct_sketch", F.lit(True)).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))
    return merged.select(*keys, *T.StructType.fromDDL(STATE).fieldNames())


def profile_of_states(states: DataFrame, *keys: str) -> DataFrame:
    """The profile that merged states describe: nulls, distinct values, moments, quartiles and lengths per column."""
    n, rows = F.col("value_count"), F.col("total_rows")
    sketch = F.col("quantile_sketch")
    quantiles = [F.when((n > 0) & F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(p))).alias(name)
                 for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    return states.select(
        *keys, "ordinal_position", "column_name", "data_type", "total_rows", (rows - n).alias("null_count"),
        F.round(F.coalesce(F.try_divide(rows - n, rows), F.lit(0.0)), 4).alias("null_fraction"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), "min", "max", F.col("mean").alias("avg"),
        F.sqrt(F.try_divide("spread", F.when(n > 1, n - 1))).alias("std"), *quantiles, "min_text", "max_text", "min_length",
        "max_length", F.try_divide("length_sum", n).alias("avg_length"))


def append_states(df: DataFrame, path: str, partition: Column) -> DataFrame:
    """Profile the partitions of ``df`` that the table of states at ``path`` does not have yet, and append their states.

    ``partition`` names the partition of a row as text; rows where it is null are a partition as well. Only rows of new
    partitions are aggregated, in one pass for all of them. Returns the whole table of states.
    """
    spark = df.sparkSession
    name = partition.cast("string")
    part, = free_names(df.columns, "_partition")
    fresh, known = df.withColumn(part, name), stored_states(spark, path)
    if known is not None:
        stored = known.select(F.col("partition").alias("stored")).distinct()
        fresh = fresh.join(stored, F.col(part).eqNullSafe(F.col("stored")), "left_anti")
    grouped_states(fresh, part, df.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of states at ``path``, or None if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def grouped_states(df: DataFrame, partition: str, cols: Sequence[str]) -> DataFrame:
    """The states of every partition of ``df``, as ``partition`` and the columns of ``profile_state``."""
    df = nan_to_null(df)
    wide = df.groupBy(col(partition).alias("partition")).agg(*[p.alias(f"p{i}") for i, p in enumerate(_column_states(df, cols))])
    return wide.select("partition", F.inline(F.array(*[F.col(f"p{i}") for i in range(len(cols))])))


def state_drift(states: DataFrame) -> DataFrame:
    """Change of each column's null share, distinct values, mean and median from one partition's state to the next one's."""
    profile = profile_of_states(states, "partition")
    # One row per partition and column, so the window holds a column's history.
    w = Window.partitionBy("column_name").orderBy("partition")
    measures = ("null_fraction", "distinct_count", "avg", "median")
    return profile.select("partition", "column_name", *measures, *[
        (F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in measures])
