"""Empty and one-row tables, and tables with one kind of column, through the operators that index, bin or join."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import ask, context, conversations, deep, drift, evaluate, features, gaps, insights, profile, quality, synthetic, usage

SCHEMA = "k long, ts timestamp_ntz, g string, x double, y double"
ROW = [(1, None, "a", 2.0, None)]


@pytest.fixture(scope="module", params=[0, 1])
def small(spark, request):
    df = spark.createDataFrame(ROW, SCHEMA).withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    return df.limit(request.param)


CASES = {
    "downsample": lambda d: insights.downsample(d, ["k"]),
    "growth": lambda d: insights.growth_metrics(d, ["k"]),
    "risk": lambda d: insights.risk_indicators(d),
    "score": lambda d: insights.performance_score(d, ["k"]),
    "kpis": lambda d: insights.executive_kpis(d, ["k"]),
    "projection": lambda d: ask.linear_projection(d, ["k"]),
    "statistics": lambda d: ask.column_statistics(d),
    "skew": lambda d: ask.skew_comparison(d),
    "advice": lambda d: ask.advice(d, ["k"]),
    "assessment": lambda d: ask.quality_assessment(d),
    "extended": lambda d: profile.profile_columns(d),
    "with_tops": lambda d: profile.profile_with_top_values(d),
    "summary": lambda d: profile.table_summary(d),
    "issues": lambda d: quality.issues(d),
    "classes": lambda d: quality.value_classes(d),
    "regression": lambda d: evaluate.regression_metrics(d, "x", "y"),
    "calibration": lambda d: evaluate.calibration(d, "x", "y"),
    "qini": lambda d: evaluate.qini(d, "x", F.col("k") > 0, "x"),
    "top_share": lambda d: evaluate.top_share_metrics(d, "x", "k", "k"),
    "spearman": lambda d: evaluate.spearman(d, "x", "y"),
    "entropy": lambda d: evaluate.action_entropy(d, "g"),
    "lift": lambda d: evaluate.lift(d, F.col("k") > 0, F.col("x"), F.col("y")),
    "elasticity": lambda d: evaluate.elasticity(d, ["g"], "x", "x"),
    "lags": lambda d: features.lag_features(d, ["g"], ["k"], "x"),
    "splits": lambda d: features.time_splits(d, "ts"),
    "checks": lambda d: features.pipeline_checks(d, {"x": F.col("x") > 0}),
    "psi": lambda d: drift.psi(d, ["x", "y"], F.col("k") > 0),
    "ks": lambda d: drift.ks(d, ["x", "y"], F.col("k") > 0),
    "freshness": lambda d: drift.freshness(d, "ts", "2024-01-02 00:00:00", 1.0),
    "magnitude": lambda d: deep.outlier_magnitude(d),
    "kinds": lambda d: deep.correlation_kinds(d, [("x", "y")]),
    "segments": lambda d: deep.segment_difference(d, "g", "x"),
    "association": lambda d: deep.categorical_association(d, "g", "g2") if "g2" in d.columns else deep.categorical_association(d.withColumn("g2", F.col("g")), "g", "g2"),
    "series": lambda d: deep.trend_type(deep.bucket_series(d, "ts", "hour", F.sum("x"))),
    "change": lambda d: deep.change_point(deep.bucket_series(d, "ts", "hour", F.sum("x"))),
    "spikes": lambda d: deep.spikes(deep.bucket_series(d, "ts", "hour", F.sum("x"))),
    "seasons": lambda d: deep.seasonality(deep.bucket_series(d, "ts", "hour", F.sum("x"))),
    "combinations": lambda d: deep.frequent_combinations(d, ["g", "k"]),
    "groups": lambda d: deep.subpopulations(d, ["g"], "x"),
    "synthetic": lambda d: synthetic.synthesize(d.select("k", "g", "x", "ts"), 5),
    "threads": lambda d: conversations.threads(d.select(F.col("k").alias("conv_id"), F.col("k").alias("turn"))),
    "duplicates": lambda d: context.duplicate_documents(d, "k", "g"),
    "retention": lambda d: usage.apply_retention(d, "2024-01-02 00:00:00", at="ts"),
}


@pytest.mark.parametrize("name", CASES)
def test_small_tables(small, name):
    CASES[name](small).collect()


TABLE_REPORTS = {
    "trends": lambda d, o: insights.trends(d, o),
    "outliers": lambda d, o: insights.iqr_outliers(d),
    "metrics": lambda d, o: insights.key_metrics(d),
    "kpis": lambda d, o: insights.executive_kpis(d, o),
    "downsample": lambda d, o: insights.downsample(d, o),
    "histogram": lambda d, o: insights.histogram(d),
    "growth": lambda d, o: insights.growth_metrics(d, o),
    "risk": lambda d, o: insights.risk_indicators(d),
    "score": lambda d, o: insights.performance_score(d, o),
    "correlations": lambda d, o: insights.correlations(d),
    "advice": lambda d, o: insights.recommendations(d),
    "summary": lambda d, o: insights.dataset_summary(d),
    "accuracy": lambda d, o: quality.accuracy(d),
    "classes": lambda d, o: quality.value_classes(d),
    "validity": lambda d, o: quality.validity(d),
    "issues": lambda d, o: quality.issues(d),
    "report": lambda d, o: quality.quality_report(d),
    "overview": lambda d, o: ask.overview(d),
    "statistics": lambda d, o: ask.column_statistics(d),
    "bands": lambda d, o: ask.trend_bands(d, o),
    "skew": lambda d, o: ask.skew_comparison(d),
    "quick": lambda d, o: ask.quick_insights(d),
    "ask_advice": lambda d, o: ask.advice(d, o),
    "assessment": lambda d, o: ask.quality_assessment(d),
    "projection": lambda d, o: ask.linear_projection(d, o),
    "pairs": lambda d, o: ask.correlation_list(d),
    "profile": lambda d, o: profile.profile_table(d),
    "extended": lambda d, o: profile.profile_columns(d),
    "table": lambda d, o: profile.table_summary(d),
    "strings": lambda d, o: profile.string_profile(d),
    "times": lambda d, o: profile.temporal_profile(d),
    "tops": lambda d, o: profile.profile_with_top_values(d),
    "magnitude": lambda d, o: deep.outlier_magnitude(d),
    "coverage": lambda d, o: gaps.coverage_gaps(d),
    "relationships": lambda d, o: gaps.relationship_gaps(d),
    "diversity": lambda d, o: gaps.diversity(d),
    "gap_advice": lambda d, o: gaps.gap_recommendations(d),
}
KINDS = {
    "texts": ("a string, b string", [("x", "y"), ("z", None), ("x", "1")]),
    "numbers": ("a int, b double", [(1, 2.0), (2, None), (3, 5.0)]),
    "one_number": ("a int, b string", [(1, "x"), (2, None), (3, "y")]),
    "times": ("a timestamp_ntz", [(datetime.datetime(2024, 1, d),) for d in (1, 2, 5)]),
    "no_rows": ("a string, b int, c date", []),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", TABLE_REPORTS)
def test_column_kinds(spark, kind, name):
    schema, rows = KINDS[kind]
    TABLE_REPORTS[name](spark.createDataFrame(rows, schema), ["a"]).collect()


def test_reports_look_at_every_column(spark):
    """Twelve columns with an outlier each; nothing stops after the first few."""
    names = [f"c{i:02d}" for i in range(12)]
    df = spark.createDataFrame([tuple(float(i % 10 + j) if i < 40 else 1000.0 + j for j in range(12)) + (i,) for i in range(41)],
                               ", ".join(f"{n} double" for n in names) + ", k long")
    for report in (insights.trends(df, ["k"]), insights.iqr_outliers(df), insights.key_metrics(df), ask.trend_bands(df, ["k"]),
                   insights.growth_metrics(df, ["k"]), ask.linear_projection(df, ["k"]), ask.skew_comparison(df), ask.overview(df)):
        assert set(names) <= {r.column_name for r in report.collect()}
    assert {r.metric for r in insights.risk_indicators(df).collect()} >= set(names)
    assert {r.name for r in insights.executive_kpis(df, ["k"]).collect()} >= set(names)
    assert insights.correlations(df).count() >= 66


def test_histogram_leaves_infinite_values_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),)], "x double")
    assert sum(r["count"] for r in insights.histogram(df).collect()) == 2
