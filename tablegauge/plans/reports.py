"""Insight, quality, gap and question queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablegauge.operators import ask as A
from tablegauge.operators import gaps as G
from tablegauge.operators import insights as I
from tablegauge.operators import quality as D
from tablegauge.plans.registry import each, load, query, rnd
from tablegauge.plans.views import FLAGS_SQL, LABELLED_SQL, SALES_SQL, flags, labelled, sales
from tablegauge.session import materialize

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = LINE_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]
EVENT_NUM = ["event_id", "user_id", "value"]
LABEL_ALL = ["lang", "source", "n_chars", "quality", "toxic"]
LABEL_NUM = ["n_chars", "quality", "toxic"]
ORDER = ["ts", "event_id"]
FIRST = "(SELECT {c} FROM events ORDER BY ts, event_id LIMIT 1)::DOUBLE"
LAST = "(SELECT {c} FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)::DOUBLE"
NUMBERED_EVENTS = ("SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index, "
                   "count(*) OVER () AS n FROM events")


def q(c: str, p: float) -> str:
    return f"quantile_cont({c}::DOUBLE, {p})"


def fences(c: str, source: str) -> str:
    return (f"SELECT {q(c, .25)} - 1.5 * ({q(c, .75)} - {q(c, .25)}) AS lo, "
            f"{q(c, .75)} + 1.5 * ({q(c, .75)} - {q(c, .25)}) AS hi FROM {source}")


def outliers_sql(cols, source, select) -> str:
    """``select`` once per column over t joined with its fences b."""
    return " UNION ALL ".join(
        f"SELECT {select.format(c=c, i=i)} FROM {source} t, ({fences(c, source)}) b" for i, c in enumerate(cols))


OUT = "count(*) FILTER (WHERE {c} < lo OR {c} > hi)"


def missing_sql(cols) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in cols)


def duplicates_sql(source: str) -> str:
    return f"(SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))"


def numbered_sql(texts: list[tuple[str, str]], source: str, name: str = "recommendation") -> str:
    """(condition, text) pairs over one row, kept ones numbered from 1."""
    rows = " UNION ALL ".join(
        f"SELECT {i} AS o, {text} AS t, {cond} AS k FROM s" for i, (cond, text) in enumerate(texts))
    return (f"WITH s AS ({source}), r AS ({rows}) SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, "
            f"t AS {name} FROM r WHERE k")


# --- insights -------------------------------------------------------------

@query("i1_dataset_summary",
       "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, '" + ", ".join(LINE_NUM)
       + "' AS numeric_names, 'Dataset contains ' || count(*) || ' rows and 11 columns. "
         "Key numeric metrics available: " + ", ".join(LINE_NUM) + "' AS summary FROM lineitem")
def _(spark, d):
    return I.dataset_summary(load(spark, d, "lineitem"))


@query("i2_trends", rnd(each(
    f"SELECT '{{c}}' AS column_name, CASE WHEN {LAST} > {FIRST} THEN 'increasing' ELSE 'decreasing' END AS direction, "
    f"({LAST} - {FIRST}) / (SELECT count(*) FROM events) AS average_change, '{{c}} shows ' || CASE WHEN {LAST} > {FIRST} THEN 'increasing' ELSE 'decreasing' END || ' trend' AS description", EVENT_NUM), "average_change"))
def _(spark, d):
    return I.trends(load(spark, d, "events"), ORDER)


@query("i3_iqr_outliers", rnd(
    "SELECT * FROM (" + outliers_sql(
        LINE_NUM, "lineitem",
        "'{c}' AS column_name, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, " + OUT
        + " AS outlier_count, " + OUT + " * 100.0 / count(*) AS percentage, " + OUT + " || ' outliers detected in {c}' AS description") + ") WHERE outlier_count > 0",
    "lower_bound", "upper_bound", "percentage"))
def _(spark, d):
    return I.iqr_outliers(load(spark, d, "lineitem"))


@query("i3_iqr_outliers_sales", rnd(
    f"WITH v AS ({SALES_SQL}) SELECT * FROM (" + outliers_sql(
        ["sales", "quantity", "price"], "v",
        "'{c}' AS column_name, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, " + OUT
        + " AS outlier_count, " + OUT + " * 100.0 / count(*) AS percentage, " + OUT + " || ' outliers detected in {c}' AS description") + ") WHERE outlier_count > 0",
    "lower_bound", "upper_bound", "percentage"))
def _(spark, d):
    return I.iqr_outliers(materialize(sales(spark, d), "sales"))


def corr_sql(cols, source) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS pair_position, '{a}' AS column1, '{b}' AS column2, corr({a}::DOUBLE, {b}::DOUBLE) AS correlation FROM {source}"
        for i, (a, b) in enumerate(combinations(cols, 2)))


@query("i4_pair_correlations", rnd(corr_sql(LINE_NUM, "lineitem"), "correlation"))
def _(spark, d):
    return I.pair_correlations(load(spark, d, "lineitem"))


@query("i4_correlations", rnd(
    f"SELECT column1, column2, correlation, CASE WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength "
    f"FROM ({corr_sql(LINE_NUM, 'lineitem')}) WHERE abs(correlation) > 0.5 "
    f"ORDER BY abs(correlation) DESC, pair_position", "correlation"))
def _(spark, d):
    return I.correlations(load(spark, d, "lineitem"))


def sparse_names_sql(cols, share) -> str:
    listed = ", ".join(f"CASE WHEN count(*) - count({c}) > count(*) * {share} THEN '{c}' END" for c in cols)
    kept = f"list_filter([{listed}], lambda x: x IS NOT NULL)"
    return kept


@query("i5_recommendations", numbered_sql(
    [("len(sparse) > 0", "'Consider addressing data quality issues: ' || array_to_string(sparse, ', ') || "
                         "' have significant missing values'")]
    + [(f"d{i} = 1", f"'{c} has no variation - may not be useful for analysis'") for i, c in enumerate(LABEL_ALL)]
    + [("true", f"'{t}'") for t in I.GENERAL_ADVICE],
    f"SELECT {sparse_names_sql(LABEL_ALL, 0.1)} AS sparse, "
    + each("count(DISTINCT {c}) AS d{i}", LABEL_ALL, ", ") + f" FROM ({LABELLED_SQL})"))
def _(spark, d):
    return I.recommendations(labelled(spark, d))


@query("i6_key_metrics", rnd(each(
    "SELECT '{c}' AS column_name, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, "
    "stddev_samp({c}::DOUBLE) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem", LINE_NUM),
    "mean", "median", "std", "min", "max"))
def _(spark, d):
    return I.key_metrics(load(spark, d, "lineitem"))


@query("i7_executive_kpis", rnd(each(
    "SELECT '{c}' AS name, avg({c}::DOUBLE) AS value, "
    f"CASE WHEN count(*) > 1 AND {FIRST} <> 0 THEN ({LAST} - {FIRST}) / {FIRST} * 100 ELSE 0 END AS trend, "
    f"CASE WHEN count(*) > 1 AND {FIRST} <> 0 AND ({LAST} - {FIRST}) / {FIRST} * 100 > 0 THEN 'up' ELSE 'down' END AS trend_direction, "
    "min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM events", EVENT_NUM),
    "value", "trend", "min", "max"))
def _(spark, d):
    return I.executive_kpis(load(spark, d, "events"), ORDER)


@query("i8_downsample", rnd(
    "SELECT row_index, event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, coalesce(value, 0) AS value "
    f"FROM ({NUMBERED_EVENTS}) WHERE row_index % greatest(1, n // 50) = 0", "event_id", "user_id", "value"))
def _(spark, d):
    return I.downsample(load(spark, d, "events"), ORDER)


@query("i9_histogram", rnd(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(b AS INTEGER) AS bin, "
        f"printf('%.1f-%.1f', lo + b * w, CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * w END) AS range, "
        f"(SELECT count(*) FROM sales_v v WHERE v.{c} >= lo + b * w AND (CASE WHEN b = 9 THEN v.{c} <= hi ELSE v.{c} < lo + (b + 1) * w END)) AS count, "
        f"(SELECT count(*) FROM sales_v v WHERE v.{c} >= lo + b * w AND (CASE WHEN b = 9 THEN v.{c} <= hi ELSE v.{c} < lo + (b + 1) * w END)) "
        f"* 100.0 / (SELECT count(*) FROM sales_v) AS percentage "
        f"FROM range(10) r(b), (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (max({c}) - min({c}))::DOUBLE / 10 AS w FROM sales_v)"
        for c in ("sales", "quantity", "price")).join([f"WITH sales_v AS ({SALES_SQL}) SELECT * FROM (", ")"]),
    "percentage"))
def _(spark, d):
    return I.histogram(materialize(sales(spark, d), "sales"))


@query("i10_growth_metrics", rnd(
    f"WITH e AS ({NUMBERED_EVENTS}), g AS (" + each(
        "SELECT '{c}' AS column_name, avg({c}) FILTER (WHERE row_index < n // 2) AS a, "
        f"avg({{c}}) FILTER (WHERE row_index >= n // 2) AS z, {FIRST} AS f, {LAST} AS l, max(n) AS n FROM e", EVENT_NUM)
    + ") SELECT column_name, CASE WHEN a <> 0 THEN (z - a) / a * 100 ELSE 0 END AS growth_rate, "
      "CASE WHEN f = 0 THEN 0 WHEN l / f >= 0 THEN (pow(l / f, 1 / greatest(1, n / 12)) - 1) * 100 END AS cagr, "
      "CASE WHEN a <> 0 AND (z - a) / a > 0 THEN 'accelerating' ELSE 'decelerating' END AS momentum FROM g",
    "growth_rate", "cagr"))
def _(spark, d):
    return I.growth_metrics(load(spark, d, "events"), ORDER)


@query("i11_risk_indicators", rnd(
    "SELECT metric, volatility, outlier_percentage, CASE WHEN volatility > 50 OR outlier_percentage > 10 THEN 'high' "
    "WHEN volatility > 25 OR outlier_percentage > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM ("
    + outliers_sql(LINE_NUM, "lineitem",
                   "'{c}' AS metric, CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}::DOUBLE) / avg({c}::DOUBLE) * 100 ELSE 0 END AS volatility, "
                   + OUT + " * 100.0 / count(*) AS outlier_percentage") + ")",
    "volatility", "outlier_percentage"))
def _(spark, d):
    return I.risk_indicators(load(spark, d, "lineitem"))


def mean_cv_sql(cols) -> str:
    return ("list_avg(list_filter([" + ", ".join(
        f"CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}::DOUBLE) / avg({c}::DOUBLE) END" for c in cols)
        + "], lambda x: x IS NOT NULL))")


EVENT_ALL = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("i12_performance_score", rnd(
    f"WITH s AS (SELECT (1 - ({missing_sql(EVENT_ALL)}) / (count(*) * 6.0)) * 100 AS data_quality, "
    f"greatest(0, 100 - {mean_cv_sql(EVENT_NUM)} * 100) AS consistency, "
    "coalesce(list_avg(list_filter([" + each(
        f"CASE WHEN {FIRST} <> 0 THEN least(100, greatest(0, 50 + ({LAST} - {FIRST}) / {FIRST} * 100)) END", EVENT_NUM, ", ")
    + "], lambda x: x IS NOT NULL)), 50) AS growth FROM events), "
      "o AS (SELECT *, data_quality * 0.3 + consistency * 0.3 + growth * 0.4 AS overall_score FROM s) "
      "SELECT overall_score, CASE WHEN overall_score >= 80 THEN 'excellent' WHEN overall_score >= 60 THEN 'good' "
      "WHEN overall_score >= 40 THEN 'fair' ELSE 'needs attention' END AS health, data_quality, consistency, growth FROM o",
    "overall_score", "data_quality", "consistency", "growth"))
def _(spark, d):
    return I.performance_score(load(spark, d, "events"), ORDER)


# --- quality --------------------------------------------------------------

LAB = f"({LABELLED_SQL})"
COMPLETE = f"(1 - ({missing_sql(LABEL_ALL)}) / (count(*) * 5.0)) * 100"


@query("d1_overall_score", rnd(
    f"SELECT round({COMPLETE} * 0.6 + (1 - {duplicates_sql(LAB)}::DOUBLE / count(*)) * 100 * 0.4, 2) AS overall_score FROM {LAB}",
    "overall_score", digits=2))
def _(spark, d):
    return D.overall_score(labelled(spark, d))


@query("d2_completeness_score", rnd(f"SELECT {COMPLETE} AS completeness_score FROM {LAB}", "completeness_score"))
def _(spark, d):
    return D.completeness_score(labelled(spark, d))


@query("d3_consistency_score", rnd(
    f"SELECT {duplicates_sql('(' + FLAGS_SQL + ')')} AS duplicate_rows, (1 - {duplicates_sql('(' + FLAGS_SQL + ')')}::DOUBLE / count(*)) * 100 AS consistency_score FROM lineitem",
    "consistency_score"))
def _(spark, d):
    return D.consistency_score(flags(spark, d))


@query("d4_completeness_detail", rnd(
    f"WITH v AS ({LABELLED_SQL}) SELECT * FROM (" + each(
        "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        "round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage, "
        f"{missing_sql(LABEL_ALL)} AS total_missing, count(*) * 5 AS total_cells, {COMPLETE} AS completeness_percentage FROM v",
        LABEL_ALL) + ") WHERE missing_count > 0", "missing_percentage", "completeness_percentage"))
def _(spark, d):
    return D.completeness_detail(labelled(spark, d))


@query("d5_accuracy", rnd(
    "WITH o AS (" + outliers_sql(LINE_NUM, "lineitem", "'{c}' AS column_name, " + OUT + " AS outlier_count, " + OUT
                                 + " * 100.0 / count(*) AS percentage")
    + ") SELECT *, CAST(greatest(0, 100 - 10 * (SELECT count(*) FROM o WHERE outlier_count > 0)) AS INTEGER) AS accuracy_score "
      "FROM o WHERE outlier_count > 0", "percentage"))
def _(spark, d):
    return D.accuracy(load(spark, d, "lineitem"))


@query("d6_consistency_detail", rnd(
    f"SELECT {duplicates_sql('(' + FLAGS_SQL + ')')} AS duplicate_rows, "
    f"round({duplicates_sql('(' + FLAGS_SQL + ')')} * 100.0 / count(*), 2) AS duplicate_percentage, "
    f"(1 - {duplicates_sql('(' + FLAGS_SQL + ')')}::DOUBLE / count(*)) * 100 AS consistency_score FROM lineitem",
    "duplicate_percentage", "consistency_score"))
def _(spark, d):
    return D.consistency_detail(flags(spark, d))


CLASS_TEXTS = ("SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) "
               "WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS v FROM orders")
KIND = ("CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN 'int' "
        "WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' "
        "WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date' "
        "WHEN lower(trim({c})) IN ('true', 'false') THEN 'bool' ELSE 'text' END")


@query("d6_value_classes",
       f"WITH t AS ({CLASS_TEXTS}), u AS (SELECT 'k' AS column_name, {KIND.format(c='k')} AS kind FROM t UNION ALL "
       f"SELECT 'v', {KIND.format(c='v')} FROM t) SELECT column_name, "
       + each("count(*) FILTER (WHERE kind = '{c}') AS {c}_count", ["int", "float", "date", "bool", "text"], ", ")
       + ", count(DISTINCT kind) > 1 AS mixed_types FROM u GROUP BY column_name")
def _(spark, d):
    o = load(spark, d, "orders")
    return D.value_classes(o.select(
        F.col("o_orderkey").cast("string").alias("k"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.col("o_orderpriority")).alias("v")))


NEGATIVE_SQL = ("SELECT l_extendedprice * (1 - l_discount) - 900 * l_quantity AS revenue, l_extendedprice AS price, "
                "l_quantity AS quantity FROM lineitem")


@query("d7_validity",
       f"WITH v AS ({NEGATIVE_SQL}), i AS (" + each(
           "SELECT '{c}' AS column_name, 'negative_values' AS issue, count(*) FILTER (WHERE {c} < 0) AS count FROM v",
           ["revenue", "price"]) + ") SELECT *, CAST(greatest(0, 100 - 15 * (SELECT count(*) FROM i WHERE count > 0)) AS INTEGER) "
       "AS validity_score FROM i WHERE count > 0")
def _(spark, d):
    return D.validity(load(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 900 * F.col("l_quantity")).alias("revenue"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")))


@query("d8_issues",
       f"WITH v AS ({LABELLED_SQL}), m AS (" + each(
           "SELECT {i} AS position, 'high' AS severity, 'missing_data' AS type, '{c}' AS column_name, count(*) - count({c}) AS count, "
           "'{c} has ' || (count(*) - count({c})) || printf(' missing values (%.1f%%)', (count(*) - count({c})) * 100.0 / count(*)) AS description, "
           "'Consider imputation or data collection' AS recommendation, count(*) - count({c}) > count(*) * 0.1 AS f FROM v", LABEL_ALL)
       + f" UNION ALL SELECT 5, 'medium', 'duplicates', NULL, {duplicates_sql('v')}, {duplicates_sql('v')} || ' duplicate rows found', "
         f"'Review and remove duplicate records if not intentional', {duplicates_sql('v')} > 0 UNION ALL "
       + outliers_sql(LABEL_NUM, "v", "6 + {i}, 'medium', 'outliers', '{c}', " + OUT + ", " + OUT + " || ' outliers detected in {c}', "
                      "'Investigate outliers for data entry errors or special cases', " + OUT + " > count(*) * 0.05")
       + ") SELECT CAST(position AS INTEGER) AS position, severity, type, column_name, count, description, recommendation FROM m WHERE f")
def _(spark, d):
    return D.issues(materialize(labelled(spark, d), "labelled"))


@query("d9_quality_recommendations", numbered_sql(
    [("m > 0", "'Address missing data through imputation or data collection'"),
     ("d > 0", "'Remove or investigate duplicate records'"),
     ("n < 100", "'Dataset may benefit from more samples for reliable analysis'")],
    f"SELECT {missing_sql(LABEL_ALL)} AS m, {duplicates_sql(LAB)} AS d, count(*) AS n FROM {LAB}"))
def _(spark, d):
    return D.quality_recommendations(labelled(spark, d))


@query("d10_quality_report", rnd(
    f"WITH v AS ({LABELLED_SQL}), o AS (" + outliers_sql(LABEL_NUM, "v", "'{c}' AS c, " + OUT + " AS k, count(*) AS n")
    + "), m AS (" + each("SELECT '{c}' AS c, count(*) - count({c}) AS k, count(*) AS n FROM v", LABEL_ALL)
    + f"), d AS (SELECT {duplicates_sql('v')} AS k), s AS (SELECT {COMPLETE} AS complete, "
      f"(1 - {duplicates_sql('v')}::DOUBLE / count(*)) * 100 AS uniq, {missing_sql(LABEL_ALL)} AS miss, count(*) * 5 AS cells FROM v) "
      "SELECT 'overall' AS section, 'overall_score' AS metric, NULL::VARCHAR AS column_name, round(complete * 0.6 + uniq * 0.4, 2) AS value FROM s "
      "UNION ALL SELECT 'completeness', 'total_missing', NULL, miss FROM s "
      "UNION ALL SELECT 'completeness', 'total_cells', NULL, cells FROM s "
      "UNION ALL SELECT 'completeness', 'completeness_percentage', NULL, complete FROM s "
      "UNION ALL SELECT 'accuracy', 'accuracy_score', NULL, greatest(0, 100 - 10 * count(*)) FROM o WHERE k > 0 "
      "UNION ALL SELECT 'consistency', 'duplicate_rows', NULL, k FROM d "
      "UNION ALL SELECT 'consistency', 'consistency_score', NULL, uniq FROM s "
      "UNION ALL SELECT 'validity', 'validity_score', NULL, 100 "
      "UNION ALL SELECT 'completeness', 'missing_count', c, k FROM m WHERE k > 0 "
      "UNION ALL SELECT 'accuracy', 'outliers', c, k FROM o WHERE k > 0 "
      "UNION ALL SELECT 'issues', 'missing_data', c, k FROM m WHERE k > n * 0.1 "
      "UNION ALL SELECT 'issues', 'duplicates', NULL, k FROM d WHERE k > 0 "
      "UNION ALL SELECT 'issues', 'outliers', c, k FROM o WHERE k > n * 0.05", "value"))
def _(spark, d):
    return D.quality_report(materialize(labelled(spark, d), "labelled"))


TREND_SQL = ("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS row_count, "
             "(1 - ((count(*) - count(p)) + (count(*) - count(o_custkey))) / (count(*) * 2.0)) * 100 AS completeness "
             "FROM (SELECT *, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS p FROM orders) GROUP BY 1")


@query("d11_quality_trend", rnd(
    f"WITH r AS (SELECT 'orders' AS dataset, strftime(period, '%Y-%m-%d') AS period, completeness FROM ({TREND_SQL})), "
    "g AS (SELECT *, completeness - lag(completeness) OVER (PARTITION BY dataset ORDER BY period) AS score_change FROM r) "
    "SELECT *, CASE WHEN score_change > 0 THEN 'improving' WHEN score_change < 0 THEN 'declining' "
    "WHEN score_change IS NOT NULL THEN 'stable' END AS direction FROM g", "completeness", "score_change"))
def _(spark, d):
    o = load(spark, d, "orders").withColumn(
        "p", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    reports = D.daily_completeness(o, "o_orderdate", ["p", "o_custkey"], "month").select(
        F.lit("orders").alias("dataset"), F.col("period").cast("string").alias("period"), "completeness")
    return D.quality_trend(reports, ["dataset"], "period", "completeness")


# --- gaps -----------------------------------------------------------------

@query("g1_temporal_gaps",
       "SELECT true AS has_temporal_data, 'l_shipdate' AS date_columns, "
       "CAST(datediff('day', min(l_shipdate), max(l_shipdate)) AS BIGINT) AS time_span_days, count(*) AS total_periods FROM lineitem")
def _(spark, d):
    return G.temporal_gaps(load(spark, d, "lineitem"))


@query("g1_temporal_gaps_events",
       "SELECT true AS has_temporal_data, 'ts' AS date_columns, "
       "CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS time_span_days, count(*) AS total_periods FROM events")
def _(spark, d):
    return G.temporal_gaps(load(spark, d, "events"))


GAP_TABLES = ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "labels"]


@query("g2_feature_gaps",
       "WITH c AS (" + each("SELECT '{c}' AS table_name, column_name, column_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AS num "
                            "FROM (DESCRIBE {c})", GAP_TABLES)
       + "), f AS (SELECT table_name, list_filter(["
         "CASE WHEN NOT bool_or(lower(column_name) LIKE '%date%' OR lower(column_name) LIKE '%time%') THEN 'temporal_dimension' END, "
         "CASE WHEN NOT bool_or(lower(column_name) LIKE '%id%' OR lower(column_name) LIKE '%key%') THEN 'identifier' END, "
         "CASE WHEN count(*) FILTER (WHERE num) < 2 THEN 'numeric_features' END, "
         "CASE WHEN count(*) FILTER (WHERE NOT num) = 0 THEN 'categorical_features' END], lambda x: x IS NOT NULL) AS g FROM c GROUP BY 1) "
         "SELECT table_name, array_to_string(g, ', ') AS identified_gaps, array_to_string(list_transform(g, lambda x: CASE x "
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SUGGESTIONS.items()) + " END), '; ') AS suggestions, CAST(len(g) AS INTEGER) AS gap_count, "
         "CASE WHEN len(g) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM f")
def _(spark, d):
    return G.feature_gaps(G.schema_rows({t: load(spark, d, t) for t in GAP_TABLES}))


@query("g3_coverage_gaps",
       f"WITH v AS ({LABELLED_SQL}), s AS (SELECT array_to_string({sparse_names_sql(LABEL_ALL, 0.2)}, ', ') AS sparse, "
       "array_to_string(list_filter([" + each("CASE WHEN count(DISTINCT {c}) < 3 AND count(*) > 10 THEN '{c}' END", LABEL_ALL, ", ")
       + "], lambda x: x IS NOT NULL), ', ') AS flat, count(*) AS n FROM v), "
         "g AS (SELECT 'high_missing_data' AS type, sparse AS columns, 'May affect analysis reliability' AS impact, CAST(NULL AS BIGINT) AS sample_count FROM s WHERE sparse <> '' "
         "UNION ALL SELECT 'low_diversity', flat, 'Limited variation may reduce analytical value', NULL FROM s WHERE flat <> '' "
         "UNION ALL SELECT 'small_sample_size', '', 'Small sample size may limit statistical significance', n FROM s WHERE n < 50) "
         "SELECT CASE WHEN (SELECT count(*) FROM g) >= 2 THEN 'high' WHEN (SELECT count(*) FROM g) = 1 THEN 'medium' ELSE 'low' END AS severity, "
         "g.* FROM (SELECT 1) one LEFT JOIN g ON true")
def _(spark, d):
    return G.coverage_gaps(labelled(spark, d))


@query("g4_relationship_gaps",
       f"SELECT true AS can_analyze_relationships, k AS strong_relationships_found, CASE WHEN k < 3 THEN "
       "'Explore feature engineering for better predictive power' ELSE 'Good relationship coverage' END AS recommendation "
       f"FROM (SELECT count(*) FILTER (WHERE abs(correlation) > 0.7 AND abs(correlation) < 1.0) AS k FROM ({corr_sql(LINE_NUM, 'lineitem')}))")
def _(spark, d):
    return G.relationship_gaps(load(spark, d, "lineitem"))


@query("g5_diversity", rnd(
    "SELECT column_name, unique_values, round(r, 3) AS diversity_ratio, CASE WHEN r > 0.8 THEN 'high' WHEN r > 0.3 THEN 'medium' ELSE 'low' END AS assessment "
    "FROM (" + each("SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, count(DISTINCT {c})::DOUBLE / count(*) AS r FROM lineitem", LINE_ALL)
    + ")", "diversity_ratio"))
def _(spark, d):
    return G.diversity(load(spark, d, "lineitem"))


@query("g6_gap_recommendations", numbered_sql(
    [("true", "'Add temporal dimension to enable time-series analysis and trend detection'"),
     ("n < 100", "'Consider collecting more samples for more reliable statistical analysis'"),
     ("m > 0", "'Address missing data to improve data quality and completeness'"),
     ("true", "'Explore feature interactions and create derived features for better insights'")],
    f"SELECT count(*) AS n, {missing_sql(LABEL_ALL)} AS m FROM {LAB}"))
def _(spark, d):
    return G.gap_recommendations(labelled(spark, d))


@query("g7_missing_periods",
       "WITH p AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS p FROM orders) "
       "SELECT strftime(x, '%Y-%m-%d') AS period FROM (SELECT unnest(generate_series((SELECT min(p) FROM p), (SELECT max(p) FROM p), INTERVAL 1 DAY)) AS x) "
       "WHERE x NOT IN (SELECT p FROM p)")
def _(spark, d):
    return G.missing_periods(load(spark, d, "orders"), "o_orderdate").select(
        F.date_format("period", "yyyy-MM-dd").alias("period"))


# --- questions ------------------------------------------------------------

INTENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'"
    for name, words in A.INTENT_WORDS.items()) + " ELSE 'general' END"


@query("a1_classify_intent", f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM conversations")
def _(spark, d):
    return A.classify_intent(load(spark, d, "conversations"), "text").select("conv_id", "turn", "intent")


# The columns of the label table, by names that the questions use.
MATCHED = {"thing": "doc_id", "quality": "quality", "and": "toxic"}
MATCH_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{c}') THEN '{c}'" for c in MATCHED) + " END"


def named_labels(spark, d):
    return load(spark, d, "labels").select(*[F.col(c).alias(n) for n, c in MATCHED.items()])


@query("a2_match_columns", f"SELECT conv_id, turn, {MATCH_SQL} AS matched_column FROM conversations")
def _(spark, d):
    return A.match_columns(load(spark, d, "conversations"), "text", named_labels(spark, d).columns).select(
        "conv_id", "turn", "matched_column")


@query("a2_answer_statistics", rnd(
    f"WITH m AS (SELECT conv_id, turn, {MATCH_SQL} AS matched_column FROM conversations), s AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS matched_column, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, "
                         f"stddev_samp({c}::DOUBLE) AS std FROM labels" for n, c in MATCHED.items())
    + ") SELECT conv_id, turn, matched_column, mean, median, std FROM m LEFT JOIN s USING (matched_column)", "mean", "median", "std"))
def _(spark, d):
    return A.answer_statistics(load(spark, d, "conversations"), "text", named_labels(spark, d)).select(
        "conv_id", "turn", "matched_column", "mean", "median", "std")


@query("a3_overview", rnd(each(
    "SELECT count(*) AS row_count, CAST(11 AS INTEGER) AS column_count, CAST(8 AS INTEGER) AS numeric_count, CAST(3 AS INTEGER) AS categorical_count, "
    f"(1 - ({missing_sql(LINE_ALL)}) / (count(*) * 11.0)) * 100 AS completeness, "
    "'{c}' AS column_name, avg({c}::DOUBLE) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem", LINE_NUM),
    "completeness", "mean", "min", "max"))
def _(spark, d):
    return A.overview(load(spark, d, "lineitem"))


@query("a4_column_statistics", rnd(
    "SELECT column_name, mean, median, std, min, max, q25, q75, cv, CASE WHEN cv > 50 THEN 'high' WHEN cv > 25 THEN 'moderate' ELSE 'low' END AS volatility, outlier_count "
    "FROM (" + outliers_sql(LINE_NUM, "lineitem",
                            "'{c}' AS column_name, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, stddev_samp({c}::DOUBLE) AS std, "
                            "min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.75) AS q75, "
                            "CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}::DOUBLE) / avg({c}::DOUBLE) * 100 ELSE 0 END AS cv, " + OUT + " AS outlier_count") + ")",
    "mean", "median", "std", "min", "max", "q25", "q75", "cv"))
def _(spark, d):
    return A.column_statistics(load(spark, d, "lineitem"))


@query("a5_trend_bands", rnd(
    f"WITH e AS ({NUMBERED_EVENTS}), g AS (" + each(
        "SELECT '{c}' AS column_name, avg({c}) FILTER (WHERE row_index < n // 2) AS a, avg({c}) FILTER (WHERE row_index >= n // 2) AS z, "
        f"CASE WHEN {FIRST} <> 0 THEN ({LAST} - {FIRST}) / {FIRST} * 100 ELSE 0 END AS change_percent FROM e", EVENT_NUM)
    + ") SELECT column_name, change_percent, CASE WHEN change_percent > 5 THEN 'increasing' WHEN change_percent < -5 THEN 'decreasing' ELSE 'stable' END AS direction, "
      "CASE WHEN z > a THEN 'accelerating' ELSE 'decelerating' END AS momentum FROM g", "change_percent"))
def _(spark, d):
    return A.trend_bands(load(spark, d, "events"), ORDER)


@query("a6_skew_comparison", rnd(
    f"WITH v AS ({SALES_SQL}), s AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, '{o}' AS other_column, avg({c}) / avg({o}) AS mean_ratio FROM v"
        for c, o in (("sales", "quantity"), ("quantity", "price"), ("price", "sales")))
    + ") SELECT *, CASE WHEN (mean - median) / median * 100 > 10 THEN 'right-skewed' WHEN (mean - median) / median * 100 < -10 THEN 'left-skewed' "
      "ELSE 'balanced' END AS skew FROM s", "mean", "median", "mean_ratio"))
def _(spark, d):
    return A.skew_comparison(materialize(sales(spark, d), "sales"))


@query("a7_quick_insights", rnd(
    f"WITH v AS ({SALES_SQL}), p AS ({corr_sql(['sales', 'quantity', 'price'], 'v')}), "
    "b AS (SELECT * FROM p WHERE correlation < 1.0 ORDER BY abs(correlation) DESC, pair_position LIMIT 1), "
    "c AS (" + each("SELECT '{c}' AS name, {i} AS i, CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) * 100 END AS cv FROM v", ["sales", "quantity", "price"])
    + "), m AS (SELECT (" + missing_sql(["date", "product_category", "sales", "quantity", "price", "customer_segment", "region"])
    + ") * 100.0 / (count(*) * 7) AS missing_percent FROM v) "
      "SELECT missing_percent, CASE WHEN missing_percent > 5 THEN 'incomplete' ELSE 'excellent' END AS data_quality, column1, column2, correlation, "
      "CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength, "
      "hi.name AS most_volatile, hi.cv AS most_volatile_cv, lo.name AS most_stable, lo.cv AS most_stable_cv FROM m, b, "
      "(SELECT * FROM c ORDER BY cv DESC, i LIMIT 1) hi, (SELECT * FROM c ORDER BY cv, i LIMIT 1) lo",
    "missing_percent", "correlation", "most_volatile_cv", "most_stable_cv"))
def _(spark, d):
    return A.quick_insights(materialize(sales(spark, d), "sales"))


@query("a8_advice", numbered_sql(
    [("true", "CASE WHEN len(sparse) > 0 THEN 'Address missing values in ' || array_to_string(sparse, ', ') ELSE 'Your data quality is good!' END"),
     ("true", "CASE WHEN len(falling) > 0 THEN 'Monitor declining metrics: ' || array_to_string(falling, ', ') ELSE 'Metrics show positive momentum!' END"),
     ("len(noisy) > 0", "'Investigate outliers in ' || array_to_string(noisy, ', ')"),
     ("true", "'Consider building predictive models or generating detailed insights'"),
     ("true", "'Create charts to visualize trends and patterns'")],
    f"SELECT {sparse_names_sql(EVENT_ALL, 0.1)} AS sparse, list_filter(["
    + each(f"CASE WHEN {LAST} < {FIRST} THEN '{{c}}' END", EVENT_NUM, ", ") + "], lambda x: x IS NOT NULL) AS falling, "
    "list_filter([" + ", ".join(
        f"(SELECT CASE WHEN {OUT.format(c=c)} > count(*) * 0.05 THEN '{c}' END FROM events t, ({fences(c, 'events')}) b)" for c in EVENT_NUM)
    + "], lambda x: x IS NOT NULL) AS noisy FROM events"))
def _(spark, d):
    return A.advice(load(spark, d, "events"), ORDER)


@query("a9_quality_assessment", rnd(
    f"WITH v AS ({LABELLED_SQL}) SELECT {COMPLETE} AS completeness, CAST(" + each("(count(*) > count({c}))::INTEGER", LABEL_ALL, " + ")
    + f" AS INTEGER) AS columns_with_missing, {duplicates_sql('v')} AS duplicate_rows, {mean_cv_sql(LABEL_NUM)} AS average_cv, "
      f"CASE WHEN {mean_cv_sql(LABEL_NUM)} < 0.5 THEN 'High' WHEN {mean_cv_sql(LABEL_NUM)} < 1 THEN 'Moderate' ELSE 'Low' END AS consistency, "
      f"{COMPLETE} * 0.6 + (100 - {duplicates_sql('v')} * 100.0 / count(*)) * 0.4 AS overall_score FROM v",
    "completeness", "average_cv", "overall_score"))
def _(spark, d):
    return A.quality_assessment(labelled(spark, d))


@query("a10_linear_projection", rnd(
    f"WITH e AS ({NUMBERED_EVENTS}), s AS (" + each(
        f"SELECT '{{c}}' AS column_name, regr_slope({{c}}::DOUBLE, row_index::DOUBLE) AS slope, {LAST} AS l FROM e", EVENT_NUM)
    + ") SELECT column_name, slope, l + slope AS next_value, CASE WHEN l <> 0 THEN slope / l * 100 ELSE 0 END AS change_percent, "
      "CASE WHEN slope > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM s", "slope", "next_value", "change_percent"))
def _(spark, d):
    return A.linear_projection(load(spark, d, "events"), ORDER)


@query("a11_correlation_list", rnd(
    "SELECT column1, column2, correlation, CASE WHEN abs(correlation) > 0.8 THEN 'very strong' WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength, "
    f"CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({corr_sql(LINE_NUM, 'lineitem')}) WHERE abs(correlation) > 0.5 "
    "ORDER BY pair_position", "correlation"))
def _(spark, d):
    return A.correlation_list(load(spark, d, "lineitem"))


# --- the same operators on inputs that have outliers and related columns -------

PRICE_COLUMNS = ["l_quantity", "price", "net", "gross", "rebate"]
PRICES_SQL = ("SELECT l_quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, "
              "l_extendedprice * (1 + l_tax) AS gross, -l_extendedprice * l_discount AS rebate FROM lineitem")


def prices(spark, d):
    p = F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(
        "l_quantity", p.alias("price"), (p * (1 - F.col("l_discount"))).alias("net"),
        (p * (1 + F.col("l_tax"))).alias("gross"), (-p * F.col("l_discount")).alias("rebate"))


@query("i3_iqr_outliers_events", rnd(
    "SELECT * FROM (" + outliers_sql(
        EVENT_NUM, "events", "'{c}' AS column_name, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, " + OUT
        + " AS outlier_count, " + OUT + " * 100.0 / count(*) AS percentage, " + OUT + " || ' outliers detected in {c}' AS description") + ") WHERE outlier_count > 0",
    "lower_bound", "upper_bound", "percentage"))
def _(spark, d):
    return I.iqr_outliers(load(spark, d, "events"))


@query("i4_correlations_prices", rnd(
    f"WITH v AS ({PRICES_SQL}) SELECT column1, column2, correlation, CASE WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength "
    f"FROM ({corr_sql(PRICE_COLUMNS, 'v')}) WHERE abs(correlation) > 0.5 ORDER BY abs(correlation) DESC, pair_position", "correlation"))
def _(spark, d):
    return I.correlations(prices(spark, d))


@query("i11_risk_indicators_events", rnd(
    "SELECT metric, volatility, outlier_percentage, CASE WHEN volatility > 50 OR outlier_percentage > 10 THEN 'high' "
    "WHEN volatility > 25 OR outlier_percentage > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM ("
    + outliers_sql(EVENT_NUM, "events",
                   "'{c}' AS metric, CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}::DOUBLE) / avg({c}::DOUBLE) * 100 ELSE 0 END AS volatility, "
                   + OUT + " * 100.0 / count(*) AS outlier_percentage") + ")", "volatility", "outlier_percentage"))
def _(spark, d):
    return I.risk_indicators(load(spark, d, "events"))


@query("d5_accuracy_events", rnd(
    "WITH o AS (" + outliers_sql(EVENT_NUM, "events", "'{c}' AS column_name, " + OUT + " AS outlier_count, " + OUT
                                 + " * 100.0 / count(*) AS percentage")
    + ") SELECT *, CAST(greatest(0, 100 - 10 * (SELECT count(*) FROM o WHERE outlier_count > 0)) AS INTEGER) AS accuracy_score "
      "FROM o WHERE outlier_count > 0", "percentage"))
def _(spark, d):
    return D.accuracy(load(spark, d, "events"))


@query("g4_relationship_gaps_prices",
       f"WITH v AS ({PRICES_SQL}) SELECT true AS can_analyze_relationships, k AS strong_relationships_found, CASE WHEN k < 3 THEN "
       "'Explore feature engineering for better predictive power' ELSE 'Good relationship coverage' END AS recommendation "
       f"FROM (SELECT count(*) FILTER (WHERE abs(correlation) > 0.7 AND abs(correlation) < 1.0) AS k FROM ({corr_sql(PRICE_COLUMNS, 'v')}))")
def _(spark, d):
    return G.relationship_gaps(prices(spark, d))


@query("a11_correlation_list_prices", rnd(
    f"WITH v AS ({PRICES_SQL}) SELECT column1, column2, correlation, CASE WHEN abs(correlation) > 0.8 THEN 'very strong' WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength, "
    f"CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({corr_sql(PRICE_COLUMNS, 'v')}) WHERE abs(correlation) > 0.5 "
    "ORDER BY pair_position", "correlation"))
def _(spark, d):
    return A.correlation_list(prices(spark, d))
