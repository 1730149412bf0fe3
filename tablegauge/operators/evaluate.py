"""Metric thresholds, evaluation packs and model metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, with_row_index
from tablegauge.functions.ordered import running_total
from tablegauge.functions.positions import boundaries, descending, mean_before, row_key
from tablegauge.functions.quantiles import exact_quantiles
from tablegauge.session import literal_table

LOWER = "lower_is_better"
HIGHER = "higher_is_better"

# The standard packs as (pack, family, metric, direction, promote, warn, fail).
PACKS = (
    ("pack_forecasting_standard", "forecasting", "MAPE", LOWER, 0.15, 0.25, 0.40),
    ("pack_forecasting_standard", "forecasting", "RMSE", LOWER, 50.0, 100.0, 200.0),
    ("pack_forecasting_standard", "forecasting", "MAE", LOWER, 30.0, 60.0, 120.0),
    ("pack_forecasting_standard", "forecasting", "forecast_bias", LOWER, 0.05, 0.15, 0.30),
    ("pack_forecasting_standard", "forecasting", "coverage_80", HIGHER, 0.75, 0.65, 0.50),
    ("pack_pricing_standard", "pricing", "revenue_lift", HIGHER, 0.03, 0.01, None),
    ("pack_pricing_standard", "pricing", "margin_impact", HIGHER, 0.05, 0.02, 0.00),
    ("pack_pricing_standard", "pricing", "elasticity_accuracy", LOWER, 0.15, 0.30, 0.50),
    ("pack_pricing_standard", "pricing", "calibration", HIGHER, 0.95, 0.85, 0.70),
    ("pack_pricing_standard", "pricing", "constraint_violations", LOWER, 0.00, 0.02, 0.10),
    ("pack_nba_standard", "next_best_action", "uplift", HIGHER, 0.10, 0.05, 0.00),
    ("pack_nba_standard", "next_best_action", "precision_at_10", HIGHER, 0.30, 0.20, 0.10),
    ("pack_nba_standard", "next_best_action", "qini_coefficient", HIGHER, 0.15, 0.08, 0.00),
    ("pack_nba_standard", "next_best_action", "incremental_revenue", HIGHER, 100000.0, 50000.0, 0.0),
    ("pack_nba_standard", "next_best_action", "action_distribution", HIGHER, 0.70, 0.50, 0.30),
    ("pack_location_standard", "location_scoring", "rank_correlation", HIGHER, 0.75, 0.60, 0.45),
    ("pack_location_standard", "location_scoring", "calibration", HIGHER, 0.90, 0.75, 0.60),
    ("pack_location_standard", "location_scoring", "hit_rate_at_10", HIGHER, 0.50, 0.35, 0.20),
    ("pack_location_standard", "location_scoring", "lift_top_decile", HIGHER, 2.5, 1.8, 1.2),
    ("pack_location_standard", "location_scoring", "geographic_coverage", HIGHER, 0.90, 0.75, 0.50),
)
PACK_SCHEMA = "pack string, family string, metric string, direction string, promote double, warn double, fail double"


def standard_packs(spark) -> DataFrame:
    return literal_table(spark, PACKS, PACK_SCHEMA)


def check_threshold(value: Column, warn: Column, fail: Column, direction: Column,
                    zero_is_unset: bool = True) -> Column:
    """pass, warn or fail. A threshold of 0 counts as not set unless
    ``zero_is_unset`` is False; a missing value gives ``missing``."""
    if zero_is_unset:
        warn, fail = F.nullif(warn, F.lit(0.0)), F.nullif(fail, F.lit(0.0))

    def beyond(limit: Column) -> Column:
        worse = F.when(direction == LOWER, value >= limit).otherwise(value <= limit)
        return limit.isNotNull() & worse

    return F.when(value.isNull(), "missing").when(beyond(fail), "fail").when(beyond(warn), "warn").otherwise("pass")


def evaluate_runs(runs: DataFrame, packs: DataFrame, zero_is_unset: bool = True) -> DataFrame:
    """Status of every pack metric for every run of the pack's family.

    ``runs``: run_id, family, metrics (map). The pack table is small; Spark
    broadcasts it below its size threshold.
    """
    joined = runs.join(packs, "family")
    value = F.try_element_at("metrics", F.col("metric"))
    return joined.select(
        "run_id", "pack", "metric", value.alias("value"),
        check_threshold(value, F.col("warn"), F.col("fail"), F.col("direction"), zero_is_unset).alias("status"))


def append_results(results: DataFrame, path: str, evaluated_at: str) -> DataFrame:
    """Append evaluation results, stamped with their time, to the table at ``path`` and return it."""
    results.withColumn("evaluated_at", F.lit(evaluated_at).cast("timestamp_ntz")).write.mode("append").parquet(path)
    return results.sparkSession.read.parquet(path)


def roll_up(results: DataFrame, keys: Sequence[str] = ("run_id", "pack")) -> DataFrame:
    """Worst status per run and pack, with counts and a text."""
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[
            F.count_if(F.col("status") == s).alias(n) for s, n in (
                ("pass", "passed"), ("warn", "warnings"), ("fail", "failures"))])
    status = F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass")
    return counts.withColumn("status", status).withColumn("summary", F.format_string(
        "Evaluation %s: %d/%d metrics passed, %d warnings, %d failures",
        F.upper("status"), "passed", "total", "warnings", "failures"))


def latest_versions(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), col(version)).alias("r")).select(key, "r.*")


def regression_measures(y: Column, f: Column) -> dict[str, Column]:
    """MAPE, RMSE, MAE, bias and R² as aggregates of actual and predicted."""
    mean_square = F.avg((y - f) * (y - f))
    return {
        "mape": F.avg(F.when(y != 0, F.abs(y - f) / F.abs(y))),
        "rmse": F.sqrt(mean_square),
        "mae": F.avg(F.abs(y - f)),
        "bias": F.try_divide(F.sum(f) - F.sum(y), F.sum(y)),
        "r2": 1 - F.try_divide(mean_square, F.var_pop(y)),
    }


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [m.alias(n) for n, m in regression_measures(col(y), col(yhat)).items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def interval_coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    inside = col(y).between(col(low), col(high))
    return df.agg(F.avg(inside.cast("int")).alias("coverage"))


def lift(df: DataFrame, treated: Column, revenue: Column, cost: Column) -> DataFrame:
    """Revenue and margin of the treated group over the baseline group, minus 1."""
    def total(flag: Column, value: Column) -> Column:
        return F.sum(F.when(flag, value))

    margin = revenue - cost
    return df.agg(
        (F.try_divide(total(treated, revenue), total(~treated, revenue)) - 1).alias("revenue_lift"),
        (F.try_divide(total(treated, margin), total(~treated, margin)) - 1).alias("margin_impact"))


def elasticity(df: DataFrame, by: Sequence[str], price: str, quantity: str) -> DataFrame:
    """Log-log slope of quantity on price per segment with at least two prices."""
    p, q = col(price), col(quantity)
    return df.filter((p > 0) & (q > 0)).groupBy(*by).agg(
        F.regr_slope(F.ln(q), F.ln(p)).alias("elasticity"), F.min(p).alias("_a"), F.max(p).alias("_z"),
        F.count(F.lit(1)).alias("observations")).filter("_a < _z").drop("_a", "_z")


def elasticity_error(estimated: DataFrame, actual: DataFrame, by: Sequence[str]) -> DataFrame:
    joined = estimated.join(actual, list(by))
    return joined.agg(F.avg(F.abs(F.col("elasticity") - F.col("actual_elasticity"))).alias("elasticity_mae"))


def score_bins(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Add ``bin`` by the score's quantile boundaries, so equal scores share one.

    Boundaries are literals; no sort and no shuffle.
    """
    edges = exact_quantiles(df, [score], [i / bins for i in range(1, bins)])
    number = F.lit(0)
    for e in edges[score]:
        number = number + (col(score) > F.lit(e)).cast("int")
    return df.withColumn("bin", number)


def calibration(df: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    """One minus the mean gap between predicted and realized over score bins."""
    binned = score_bins(df, score, bins).groupBy("bin").agg(
        F.avg(score).alias("predicted"), F.avg(outcome).alias("realized"))
    return binned.agg((1 - F.avg(F.abs(F.col("predicted") - F.col("realized")))).alias("calibration"))


def violation_rate(df: DataFrame, value: Column, low: Column, high: Column) -> DataFrame:
    return df.agg(F.avg(((value < low) | (value > high)).cast("int")).alias("violation_rate"))


def uplift(df: DataFrame, treated: Column, outcome: str) -> DataFrame:
    return df.agg((F.avg(F.when(treated, col(outcome))) - F.avg(F.when(~treated, col(outcome)))).alias("uplift"))


def top_share_metrics(df: DataFrame, score: str, key: str, positive: str, share: float = 0.1, k: int = 100) -> DataFrame:
    """Precision in the top share, hit rate in the top k, lift of the top decile.

    Order is by score downwards, then key. The table is not sorted: three boundary keys tell which rows come first.
    """
    n = df.count()
    named = df.select(col(score).alias("_score"), col(key).alias("_key"), col(positive).cast("double").alias("_y"))
    place = row_key(named, [*descending(F.col("_score")), "_key"])
    ends = (math.ceil(round(n * share, 6)), k, math.ceil(n / 10))
    found = boundaries(named, place, ends, n)
    top, first, decile = (mean_before(F.col("_y"), place, found.get(e)) if e else F.avg(F.lit(None).cast("double")) for e in ends)
    return named.agg(top.alias("precision_at_share"), first.alias("hit_rate_at_k"),
                     F.try_divide(decile, F.avg("_y")).alias("lift_top_decile"))


def qini(df: DataFrame, score: str, treated: Column, outcome: str, bins: int = 10) -> DataFrame:
    """Area between the cumulative gain over score bins and the straight line, per row.

    Gain after a bin is Yt - Yc * Nt / Nc over all rows scored at least that high.
    """
    y = col(outcome)
    binned = score_bins(df, score, bins).groupBy("bin").agg(
        F.sum(F.when(treated, y).otherwise(0.0)).alias("yt"), F.sum(F.when(~treated, y).otherwise(0.0)).alias("yc"),
        F.count_if(treated).alias("nt"), F.count_if(~treated).alias("nc"))
    # At most ``bins`` rows from here on.
    w = Window.orderBy(F.col("bin").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(col(c)).over(upto) for c in ("yt", "yc", "nt", "nc")}
    gain = total["yt"] - total["yc"] * F.coalesce(F.try_divide(total["nt"], total["nc"]), F.lit(0.0))
    curve = binned.select(gain.alias("g"), (total["nt"] + total["nc"]).alias("x"), F.col("bin"))
    steps = curve.select("g", "x", ((F.col("g") + F.lag("g", 1, 0.0).over(w)) / 2 * (F.col("x") - F.lag("x", 1, 0).over(w))).alias("area"))
    end = F.max_by("g", "x")
    return steps.agg(F.sum("area").alias("a"), end.alias("g"), F.max("x").alias("n")).select(
        ((F.col("a") - F.col("g") * F.col("n") / 2) / F.col("n") / F.col("n")).alias("qini"))


def incremental_revenue(df: DataFrame, treated: Column, revenue: str) -> DataFrame:
    """Treated revenue beyond what the control mean predicts for as many rows."""
    t = F.sum(F.when(treated, col(revenue)))
    return df.agg((t - F.avg(F.when(~treated, col(revenue))) * F.count_if(treated)).alias("incremental_revenue"))


def action_entropy(df: DataFrame, action: str) -> DataFrame:
    """Normalized entropy of the action shares, 0 for a single action."""
    counts = df.groupBy(action).agg(F.count(F.lit(1)).alias("n"))
    # Entropy from sums: ln N - sum(n ln n) / N, so no second pass over totals.
    total = F.sum("n")
    entropy = F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total
    k = F.count(F.lit(1))
    return counts.agg(F.when(k > 1, entropy / F.ln(k)).otherwise(0.0).alias("action_entropy"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): the mean rank of each distinct value, from value counts."""
    counts = df.filter(col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    totals = running_total(with_row_index(counts, [column]), {"_upto": "_n"})
    return totals.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Pairs are counted before the rank tables are joined, and since the mean
    rank is known, one pass of weighted sums gives the correlation.
    """
    both = df.select(x, y).filter(col(x).isNotNull() & col(y).isNotNull())
    pairs = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    n = both.count()
    joined = pairs.join(average_ranks(both, x, "_rx"), x).join(average_ranks(both, y, "_ry"), y)
    centre = (n + 1) / 2
    a, b, w = F.col("_rx") - centre, F.col("_ry") - centre, F.col("_w")
    return joined.agg(F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("spearman"))


def geographic_coverage(points: DataFrame, reached: DataFrame, lat: str, lon: str, cell: float = 1.0) -> DataFrame:
    """Share of the grid cells with points that also hold reached points."""
    def cells(df: DataFrame) -> DataFrame:
        return df.select(F.floor(col(lat) / cell).alias("a"), F.floor(col(lon) / cell).alias("b")).distinct()

    flagged = cells(points).join(cells(reached).withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return flagged.agg(F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("coverage"))


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction, overall or per slice."""
    t, p = col(label) == 1, col(predicted) == 1
    tp, fp, fn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("int")).alias("accuracy"),
            precision.alias("precision"), recall.alias("recall"),
            F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def sliced_metrics(df: DataFrame, y: str, yhat: str, dimensions: Sequence[str],
                   values: dict[str, Sequence] | None = None) -> DataFrame:
    """Regression metrics per value of each dimension, in one pass over grouping sets."""
    df = df.withColumns({d: col(d).cast("string") for d in dimensions})
    grouped = df.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"),
        *[m.alias(k) for k, m in regression_measures(col(y), col(yhat)).items()])
    width = len(dimensions)
    name = F
    for i, d in enumerate(dimensions):
        name = name.when(F.col("_g") == (1 << width) - 1 - (1 << (width - 1 - i)), d)
    result = grouped.withColumn("dimension", name).withColumn("value", F.coalesce(*dimensions)).drop("_g", *dimensions)
    for d, wanted in (values or {}).items():
        result = result.filter((F.col("dimension") != d) | F.col("value").isin(*wanted))
    return result


def compare_runs(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """Each metric next to its comparator's: value, reference, delta, relative delta."""
    r = reference.select("metric", F.col("value").alias("reference"))
    return metrics.join(r, "metric", "left").withColumn("delta", F.col("value") - F.col("reference")).withColumn(
        "relative_delta", F.try_divide("delta", F.abs("reference")))


def economic_value(comparison: DataFrame, mapping: DataFrame) -> DataFrame:
    """Metric change times its worth per unit."""
    return comparison.join(mapping, "metric").withColumn("economic_value", F.col("delta") * F.col("dollar_per_unit"))
