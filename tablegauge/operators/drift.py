"""Drift, freshness, alerts, monitor snapshots and run timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, nan_to_null, one_row_to_long, with_row_index
from tablegauge.functions.ordered import running_total
from tablegauge.functions.quantiles import exact_quantiles

PSI_BINS = 10
SHARE_FLOOR = 1e-6


def psi(df: DataFrame, features: Sequence[str], is_reference: Column, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Population stability index of each feature against the reference rows.

    Bins are the reference deciles with open ends. One pass finds the deciles,
    one more counts all bins of all features.
    """
    df = nan_to_null(df)
    edges = exact_quantiles(df.filter(is_reference), features, [i / PSI_BINS for i in range(1, PSI_BINS)])
    schema = "feature string, psi double, drifted boolean"
    if not features:
        return one_row_to_long(df, [], schema)

    def bin_of(c: str) -> Column:
        number = F.lit(0)
        for e in edges[c]:
            number = number + (col(c) > F.lit(e)).cast("int")
        return F.when(col(c).isNotNull(), number)

    # Each value's bin is worked out once; what is shuffled is one row per feature and bin.
    binned = df.select(is_reference.alias("_ref"), *[bin_of(c).alias(c) for c in features])
    counted = binned.unpivot(["_ref"], list(features), "feature", "bin").filter("bin IS NOT NULL").groupBy("feature", "bin").agg(
        F.count_if("_ref").alias("r"), F.count_if(~F.col("_ref")).alias("c"))
    by_feature = counted.groupBy("feature").agg(
        F.sum("r").alias("rn"), F.sum("c").alias("cn"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("m"))

    def term(b: Column) -> Column:
        ref, cur = (F.greatest(F.try_divide(F.coalesce(F.try_element_at("m", b)[s], F.lit(0)), F.col(f"{s}n")), F.lit(SHARE_FLOOR))
                    for s in "rc")
        return (cur - ref) * F.ln(cur / ref)

    limits = F.create_map(*[F.lit(x) for c in features for x in (c, float((thresholds or {}).get(c, 0.2)))])
    named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in features])).alias("feature"))
    psi_value = F.aggregate(F.sequence(F.lit(0), F.lit(PSI_BINS - 1)), F.lit(0.0), lambda total, b: total + term(b))
    return named.join(by_feature, "feature", "left").select("feature", psi_value.alias("psi")).withColumn(
        "drifted", F.col("psi") > limits[F.col("feature")])


def ks(df: DataFrame, features: Sequence[str], is_reference: Column, threshold: float = 0.1) -> DataFrame:
    """Largest gap between the cumulative shares of the reference and the rest.

    Rows shrink to counts per distinct value first; running totals over all
    features are then taken in blocks of one global order.
    """
    df = nan_to_null(df)
    long = df.select(is_reference.alias("_ref"), *[col(c).cast("double").alias(c) for c in features]).unpivot(
        ["_ref"], list(features), "feature", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col("_ref")).alias("ref"), F.count_if(~F.col("_ref")).alias("cur"))
    totals = running_total(with_row_index(counts, ["feature", "value"]), {"ref_upto": "ref", "cur_upto": "cur"}, ["feature"])
    sizes = totals.groupBy("feature").agg(F.sum("ref").alias("ref_n"), F.sum("cur").alias("cur_n"))
    gap = F.abs(F.try_divide("ref_upto", "ref_n") - F.try_divide("cur_upto", "cur_n"))
    return totals.join(sizes, "feature").groupBy("feature").agg(F.max(gap).alias("ks")).withColumn(
        "drifted", F.col("ks") > threshold)


def freshness(df: DataFrame, at: str, as_of: str, max_age_hours: float, by: Sequence[str] = ()) -> DataFrame:
    """Age of the newest row in hours, overall or per source."""
    newest = F.max(at).alias("_t")
    grouped = df.groupBy(*by).agg(newest) if by else df.agg(newest)
    age = F.timestamp_diff("SECOND", F.col("_t"), F.lit(as_of).cast("timestamp_ntz")) / 3600
    return grouped.select(*by, age.alias("age_hours"), (age > max_age_hours).alias("is_stale"))


def alerts(metrics: DataFrame, conditions: DataFrame) -> DataFrame:
    """Conditions that hold: metrics (subject, metric, value) against
    (metric, op, threshold, severity) rows, such as MAPE > 0.30."""
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    holds = (F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t)
             .when(op == "<=", v <= t).when(op == "==", v == t))
    return metrics.join(conditions, "metric").filter(holds)


def monitor_snapshot(model: str, captured_at: str, performance: DataFrame, psi_rows: DataFrame,
                     ks_rows: DataFrame, fresh: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """One row per model: performance map, drift, freshness and alert counts.

    Every part is a small result table; they meet as scalar subqueries.
    """
    perf = performance.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m")).scalar()
    drifted = psi_rows.select("feature", "drifted").unionByName(ks_rows.select("feature", "drifted")).filter(
        "drifted").agg(F.countDistinct("feature")).scalar()
    return fresh.select(
        F.lit(model).alias("model_id"), F.lit(captured_at).alias("captured_at"), perf.alias("performance"),
        psi_rows.agg(F.max("psi")).scalar().alias("psi"), ks_rows.agg(F.max("ks")).scalar().alias("ks_stat"),
        drifted.alias("feature_drift_count"), "age_hours", "is_stale",
        alert_rows.agg(F.count(F.lit(1))).scalar().alias("alert_count"))


def append_snapshot(snapshot: DataFrame, path: str) -> DataFrame:
    """Append monitor snapshots to the table at ``path``, partitioned by model, and return it."""
    snapshot.write.mode("append").partitionBy("model_id").parquet(path)
    return snapshot.sparkSession.read.parquet(path)


def list_snapshots(snapshots: DataFrame, model: str) -> DataFrame:
    """A model's snapshots, newest first."""
    return snapshots.filter(F.col("model_id") == model).orderBy(F.col("captured_at").desc())


def run_timeline(events: DataFrame, run: str = "run_id", state: str = "state", at: str = "event_at") -> DataFrame:
    """Start, end, duration and outcome of each run from its state events."""
    done = col(state).isin("succeeded", "failed")
    return events.groupBy(run).agg(
        F.min(F.when(col(state) == "running", col(at))).alias("started_at"),
        F.max(F.when(done, col(at))).alias("finished_at"),
        F.max_by(state, at).alias("status")).withColumn(
        "duration_seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")))


def success_rate(timeline: DataFrame) -> DataFrame:
    ended = F.col("status").isin("succeeded", "failed")
    return timeline.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ended).alias("ended"),
        F.try_divide(F.count_if(F.col("status") == "succeeded"), F.count_if(ended)).alias("success_rate"))
