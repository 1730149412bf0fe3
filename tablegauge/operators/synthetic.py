"""Synthetic tables drawn column by column from a table's statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    col, distinct_counts, nan_to_null, numeric_columns, one_row_to_long, temporal_columns, value_counts, with_row_index)
from tablegauge.functions.ordered import running_total
from tablegauge.operators.drift import ks, psi

CONTINUOUS_ABOVE = 10


def column_kinds(df: DataFrame) -> dict[str, str]:
    """continuous, discrete or moment for each column; booleans are discrete."""
    numbers, moments = numeric_columns(df), set(temporal_columns(df))
    many = {r["column_name"] for r in distinct_counts(df, numbers).filter(
        F.col("distinct_count") > CONTINUOUS_ABOVE).collect()} if numbers else set()
    return {c: "moment" if c in moments else "continuous" if c in many else "discrete" for c in df.columns}


def frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n, probability); NULL is never drawn."""
    counts = value_counts(nan_to_null(df), cols)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "column_name").select("column_name", "value", "n", (F.col("n") / F.col("_t")).alias("probability"))


def continuous_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, deviation and range of each continuous column."""
    schema = "column_name string, mean double, std double, min double, max double"
    if not cols:
        return one_row_to_long(df, [], schema)
    aggs = [f(col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols)
            for p, f in (("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("z", F.max))]
    return one_row_to_long(nan_to_null(df).agg(*aggs), [
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                 F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")) for i, c in enumerate(cols)], schema)


def _draw_table(df: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """Values as intervals of [0, total), listed per slot of a fixed width.

    Values are laid out in hash order, so rare and common ones mix and a slot
    holds about one of them, however many values there are.
    """
    counts = value_counts(df, [column]).select("value", "n", F.xxhash64("value").alias("h"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("d")).first()
    total, width = size["t"], max(1, size["t"] // max(1, size["d"]))
    laid = running_total(with_row_index(counts, ["h", "value"]), {"stop": "n"}).withColumn("start", F.col("stop") - F.col("n"))
    slots = laid.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("start") / width).cast("bigint"), F.floor((F.col("stop") - 1) / width).cast("bigint"))))
    return slots.select("slot", "start", "stop", "value"), total, width


def synthesize(df: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` rows with independent columns.

    Continuous numbers are normal, clipped to the column's range; other values
    follow their frequencies; dates run by day from the minimum.
    """
    df = nan_to_null(df)
    kinds = column_kinds(df)
    fields = {f.name: f.dataType for f in df.schema}
    measured = [c for c, k in kinds.items() if k != "discrete"]
    aggs = []
    for i, c in enumerate(measured):
        if kinds[c] == "continuous":
            v = col(c).cast("double")
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
        else:
            aggs.append(F.min(col(c)).alias(f"a{i}"))
    row = df.agg(*aggs).first() if aggs else None
    # All random numbers are drawn here, before any shuffle, so that a retried task draws the same ones.
    out = df.sparkSession.range(n).select("id", *[
        (F.randn(seed + j) if kinds[c] == "continuous" else F.rand(seed + j)).alias(f"r{j}")
        for j, c in enumerate(df.columns) if kinds[c] != "moment"])
    for j, c in enumerate(df.columns):
        if kinds[c] == "discrete":
            continue
        i = measured.index(c)
        if kinds[c] == "moment":
            low = F.lit(row[f"a{i}"]).cast(fields[c])
            value = F.date_add(low, F.col("id").cast("int")) if isinstance(fields[c], T.DateType) else (
                low + F.make_dt_interval(F.col("id").cast("int")))
        else:
            drawn = F.col(f"r{j}") * (row[f"s{i}"] or 0.0) + row[f"m{i}"]
            value = F.greatest(F.lit(row[f"a{i}"]), F.least(F.lit(row[f"z{i}"]), drawn))
        out = out.withColumn(f"c{j}", value)
    for j, c in enumerate(df.columns):
        if kinds[c] != "discrete":
            continue
        slots, total, width = _draw_table(df, c)
        if total == 0:
            out = out.withColumn(f"c{j}", F.lit(None).cast(fields[c]))
            continue
        at: Column = F.floor(F.col(f"r{j}") * total).cast("bigint")
        drawn = out.withColumn("at", at).withColumn("slot", F.floor(F.col("at") / width).cast("bigint"))
        out = drawn.join(slots, "slot").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))).withColumn(
            f"c{j}", F.col("value").cast(fields[c])).drop("at", "slot", "start", "stop", "value")
    return out.select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(df.columns)])


def synthetic_fidelity(real: DataFrame, synthetic: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PSI and KS between both tables per numeric column, and a score of 1 - KS."""
    both = real.select(*cols).withColumn("_real", F.lit(True)).unionByName(
        synthetic.select(*cols).withColumn("_real", F.lit(False)))
    flag = F.col("_real")
    stability = psi(both, cols, flag).select("feature", "psi")
    return ks(both, cols, flag).join(stability, "feature").select(
        F.col("feature").alias("column_name"), "psi", "ks", (1 - F.col("ks")).alias("quality_score"))
