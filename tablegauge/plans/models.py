"""Evaluation, feature, split, drift and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import context as X
from tablegauge.operators import drift as R
from tablegauge.operators import evaluate as E
from tablegauge.operators import features as FT
from tablegauge.operators import predict as M
from tablegauge.plans.registry import each, load, query, rnd, sql_on
from tablegauge.session import literal_table, scratch_path

# Predictions made from order lines: the price per unit of the part predicts the line's price.
PREDICTED = ("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice AS y, "
             "l_quantity * p_retailprice * (1 + l_discount) AS f FROM lineitem JOIN part ON l_partkey = p_partkey")


def predicted(spark, d):
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") * (1 + F.col("l_discount"))).alias("f"))


MEASURES = {
    "mape": "avg(CASE WHEN y <> 0 THEN abs(y - f) / abs(y) END)", "rmse": "sqrt(avg((y - f) * (y - f)))",
    "mae": "avg(abs(y - f))", "bias": "(sum(f) - sum(y)) / sum(y)", "r2": "1 - avg((y - f) * (y - f)) / var_pop(y)"}
MEASURE_SQL = ", ".join(f"{e} AS {n}" for n, e in MEASURES.items())

# Runs: one per supplier, with metrics of its order lines.
RUN_METRICS = {
    "MAPE": "avg(CASE WHEN y <> 0 THEN abs(y - f) / abs(y) END)", "RMSE": "sqrt(avg((y - f) * (y - f)))",
    "MAE": "avg(abs(y - f))", "forecast_bias": "abs((sum(f) - sum(y)) / sum(y))"}
RUNS = ("SELECT l_suppkey AS run_id, {cols} FROM (SELECT l_suppkey, l_extendedprice / 1000 AS y, l_quantity * p_retailprice / 1000 AS f "
        "FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey")
RUNS_DUCK = RUNS.format(cols=", ".join(f"{e} AS {n}" for n, e in RUN_METRICS.items()))
PACK_VALUES = ", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in p) + ")" for p in E.PACKS)
PACKS_SQL = (f"SELECT pack, family, metric, direction, promote::DOUBLE AS promote, warn::DOUBLE AS warn, fail::DOUBLE AS fail "
             f"FROM (VALUES {PACK_VALUES}) v(pack, family, metric, direction, promote, warn, fail)")


def runs(spark, d):
    pairs = ", ".join(f"'{n}', {e}" for n, e in RUN_METRICS.items())
    return sql_on(spark, d, RUNS.format(cols=f"map({pairs}) AS metrics"), "lineitem", "part").withColumn("family", F.lit("forecasting"))


def status_sql(warn: str = "nullif(warn, 0)", fail: str = "nullif(fail, 0)") -> str:
    return ("CASE WHEN value IS NULL THEN 'missing' "
            f"WHEN (direction = 'lower_is_better' AND value >= {fail}) OR (direction <> 'lower_is_better' AND value <= {fail}) THEN 'fail' "
            f"WHEN (direction = 'lower_is_better' AND value >= {warn}) OR (direction <> 'lower_is_better' AND value <= {warn}) THEN 'warn' ELSE 'pass' END")


RESULTS_SQL = (f"WITH r AS ({RUNS_DUCK}), p AS ({PACKS_SQL}), v AS (SELECT run_id, pack, metric, direction, warn, fail, CASE metric "
               + " ".join(f"WHEN '{n}' THEN {n}" for n in RUN_METRICS) + f" END AS value FROM r, p WHERE family = 'forecasting') ")


@query("e1_check_threshold",
       f"WITH p AS ({PACKS_SQL}), v AS (SELECT l_suppkey, metric, direction, warn, fail, d AS value FROM "
       f"(SELECT l_suppkey, avg(l_discount) - 0.05 AS d FROM lineitem GROUP BY l_suppkey), p WHERE family IN ('pricing', 'next_best_action')) "
       f"SELECT l_suppkey, metric, {status_sql()} AS status, {status_sql('warn', 'fail')} AS strict_status FROM v")
def _(spark, d):
    values = load(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("value"))
    # Twenty threshold rows meet every supplier through an array of structs.
    packs = [p for p in E.PACKS if p[1] in ("pricing", "next_best_action")]
    rows = F.array(*[F.struct(
        F.lit(p[2]).alias("metric"), F.lit(p[3]).alias("direction"), F.lit(p[5]).cast("double").alias("warn"),
        F.lit(p[6]).cast("double").alias("fail")) for p in packs])
    v = values.select("l_suppkey", "value", F.inline(rows))
    args = [F.col(c) for c in ("value", "warn", "fail", "direction")]
    return v.select("l_suppkey", "metric", E.check_threshold(*args).alias("status"),
                    E.check_threshold(*args, zero_is_unset=False).alias("strict_status"))


@query("e2_evaluate_runs", rnd(RESULTS_SQL + f"SELECT run_id, pack, metric, value, {status_sql()} AS status FROM v", "value"))
def _(spark, d):
    return E.evaluate_runs(runs(spark, d), E.standard_packs(spark))


@query("e2_append_results", RESULTS_SQL + f"SELECT run_id, pack, metric, {status_sql()} AS status, d.day AS evaluated_at FROM v, (VALUES ('2024-01-01'), ('2024-01-02')) d(day)")
def _(spark, d):
    path = scratch_path(spark, "evaluations")
    results = E.evaluate_runs(runs(spark, d), E.standard_packs(spark))
    for day in ("2024-01-01", "2024-01-02"):
        kept = E.append_results(results, path, f"{day} 00:00:00")
    return kept.select("run_id", "pack", "metric", "status", F.date_format("evaluated_at", "yyyy-MM-dd").alias("evaluated_at"))


@query("e3_roll_up", RESULTS_SQL + f", s AS (SELECT *, {status_sql()} AS status FROM v), "
       "c AS (SELECT run_id, pack, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warn') AS warnings, "
       "count(*) FILTER (WHERE status = 'fail') AS failures FROM s GROUP BY 1, 2), "
       "t AS (SELECT *, CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status FROM c) "
       "SELECT *, 'Evaluation ' || upper(status) || ': ' || passed || '/' || total || ' metrics passed, ' || warnings || ' warnings, ' || failures || ' failures' AS summary FROM t")
def _(spark, d):
    return E.roll_up(E.evaluate_runs(runs(spark, d), E.standard_packs(spark)))


VERSIONS = ("SELECT o_custkey AS pack_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey AS content FROM orders")


def versions(spark, d):
    return sql_on(spark, d, VERSIONS, "orders")


@query("e4_latest_pack_versions",
       f"SELECT pack_id, max(version) AS version, max_by(content, version) AS content FROM ({VERSIONS}) GROUP BY pack_id")
def _(spark, d):
    return E.latest_versions(versions(spark, d), "pack_id").withColumn("version", F.col("version").cast("bigint"))


@query("e5_regression_metrics", rnd(f"SELECT {MEASURE_SQL} FROM ({PREDICTED})", *MEASURES))
def _(spark, d):
    return E.regression_metrics(predicted(spark, d), "y", "f")


@query("e6_bias_and_coverage", rnd(
    f"SELECT avg(CASE WHEN y BETWEEN f * 0.8 AND f * 1.2 THEN 1 ELSE 0 END) AS coverage, (sum(f) - sum(y)) / sum(y) AS bias FROM ({PREDICTED})", "coverage", "bias"))
def _(spark, d):
    p = predicted(spark, d).withColumns({"lo": F.col("f") * 0.8, "hi": F.col("f") * 1.2})
    return E.interval_coverage(p, "y", "lo", "hi").withColumn(
        "bias", E.regression_metrics(p, "y", "f").select("bias").scalar())


@query("e7_lift", rnd(
    "WITH t AS (SELECT l_discount > 0.05 AS t, l_extendedprice * (1 - l_discount) AS r, l_quantity * p_retailprice * 0.6 AS c FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT sum(r) FILTER (WHERE t) / sum(r) FILTER (WHERE NOT t) - 1 AS revenue_lift, sum(r - c) FILTER (WHERE t) / sum(r - c) FILTER (WHERE NOT t) - 1 AS margin_impact FROM t",
    "revenue_lift", "margin_impact"))
def _(spark, d):
    joined = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return E.lift(joined, F.col("l_discount") > 0.05, F.col("l_extendedprice") * (1 - F.col("l_discount")),
                  F.col("l_quantity") * F.col("p_retailprice") * 0.6)


ELASTIC = ("SELECT p_brand, p_type, regr_slope(ln(l_quantity), ln(l_extendedprice / l_quantity)) AS elasticity, count(*) AS observations "
           "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2 "
           "HAVING min(l_extendedprice / l_quantity) < max(l_extendedprice / l_quantity)")


def unit_prices(spark, d):
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", "p_type", "l_quantity", F.try_divide("l_extendedprice", "l_quantity").alias("price"))


@query("e8_elasticity", rnd(ELASTIC, "elasticity"))
def _(spark, d):
    return E.elasticity(unit_prices(spark, d), ["p_brand", "p_type"], "price", "l_quantity")


@query("e8_elasticity_error", rnd(
    f"WITH s AS ({ELASTIC}), b AS ({ELASTIC.replace('p_brand, p_type,', 'p_brand,').replace('GROUP BY 1, 2', 'GROUP BY 1')}) "
    "SELECT avg(abs(s.elasticity - b.elasticity)) AS elasticity_mae FROM s JOIN b ON s.p_brand = b.p_brand", "elasticity_mae"))
def _(spark, d):
    # The whole brand's slope stands for the actual elasticity of its segments.
    prices = unit_prices(spark, d)
    segments = E.elasticity(prices, ["p_brand", "p_type"], "price", "l_quantity")
    brands = E.elasticity(prices, ["p_brand"], "price", "l_quantity").select(
        "p_brand", F.col("elasticity").alias("actual_elasticity"))
    return E.elasticity_error(segments, brands, ["p_brand"])


# Scored orders: the price share as score, open or not as outcome, customer parity as arm.
SCORED = ("SELECT o_orderkey, o_totalprice / 500000 AS score, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS positive, "
          "o_custkey % 2 = 0 AS treated, o_totalprice / 1000 AS outcome, o_orderpriority AS action FROM orders")


def scored(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500000).alias("score"),
        (F.col("o_orderstatus") == "O").cast("int").alias("positive"), (F.col("o_custkey") % 2 == 0).alias("treated"),
        (F.col("o_totalprice") / 1000).alias("outcome"), F.col("o_orderpriority").alias("action"))


BINNED = (f"s AS ({SCORED}), e AS (SELECT " + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10))
          + " FROM s), b AS (SELECT s.*, " + " + ".join(f"(score > e{i})::INTEGER" for i in range(1, 10)) + " AS bin FROM s, e)")


@query("e9_calibration", rnd(
    f"WITH {BINNED}, g AS (SELECT avg(score) AS p, avg(positive) AS r FROM b GROUP BY bin) SELECT 1 - avg(abs(p - r)) AS calibration FROM g", "calibration"))
def _(spark, d):
    return E.calibration(scored(spark, d), "score", "positive")


@query("e9_constraint_violations", rnd(
    "SELECT avg(CASE WHEN l_extendedprice < 0.85 * l_quantity * p_retailprice OR l_extendedprice > 1.25 * l_quantity * p_retailprice THEN 1 ELSE 0 END) AS violation_rate "
    "FROM lineitem JOIN part ON l_partkey = p_partkey", "violation_rate"))
def _(spark, d):
    joined = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    base = F.col("l_quantity") * F.col("p_retailprice")
    return E.violation_rate(joined, F.col("l_extendedprice"), 0.85 * base, 1.25 * base)


@query("e10_uplift", rnd(f"SELECT avg(outcome) FILTER (WHERE treated) - avg(outcome) FILTER (WHERE NOT treated) AS uplift FROM ({SCORED})", "uplift"))
def _(spark, d):
    return E.uplift(scored(spark, d), F.col("treated"), "outcome")


@query("e11_top_share_metrics", rnd(
    f"WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM s) "
    "SELECT avg(positive) FILTER (WHERE i < ceil(n * 0.1)) AS precision_at_share, avg(positive) FILTER (WHERE i < 100) AS hit_rate_at_k, "
    "avg(positive) FILTER (WHERE i < ceil(n / 10)) / avg(positive) AS lift_top_decile FROM r", "precision_at_share", "hit_rate_at_k", "lift_top_decile"))
def _(spark, d):
    return E.top_share_metrics(scored(spark, d), "score", "o_orderkey", "positive")


@query("e12_qini", rnd(
    f"WITH {BINNED}, g AS (SELECT bin, sum(CASE WHEN treated THEN outcome ELSE 0 END) AS yt, sum(CASE WHEN NOT treated THEN outcome ELSE 0 END) AS yc, "
    "count(*) FILTER (WHERE treated) AS nt, count(*) FILTER (WHERE NOT treated) AS nc FROM b GROUP BY bin), "
    "c AS (SELECT bin, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc FROM g WINDOW w AS (ORDER BY bin DESC)), "
    "p AS (SELECT bin, yt - CASE WHEN nc = 0 THEN 0 ELSE yc * nt / nc END AS g, (nt + nc)::DOUBLE AS x FROM c), "
    "a AS (SELECT g, x, (g + lag(g, 1, 0) OVER w) / 2 * (x - lag(x, 1, 0) OVER w) AS area FROM p WINDOW w AS (ORDER BY bin DESC)) "
    "SELECT (sum(area) - max_by(g, x) * max(x) / 2) / max(x) / max(x) AS qini FROM a", "qini"))
def _(spark, d):
    return E.qini(scored(spark, d), "score", F.col("treated"), "outcome")


@query("e13_incremental_revenue", rnd(
    f"SELECT sum(outcome) FILTER (WHERE treated) - avg(outcome) FILTER (WHERE NOT treated) * count(*) FILTER (WHERE treated) AS incremental_revenue FROM ({SCORED})", "incremental_revenue"))
def _(spark, d):
    return E.incremental_revenue(scored(spark, d), F.col("treated"), "outcome")


@query("e13_action_entropy", rnd(
    f"WITH c AS (SELECT action, count(*) AS n FROM ({SCORED}) GROUP BY 1), p AS (SELECT n / (SELECT sum(n) FROM c)::DOUBLE AS p FROM c) "
    "SELECT -sum(p * ln(p)) / ln(count(*)) AS action_entropy FROM p", "action_entropy"))
def _(spark, d):
    return E.action_entropy(scored(spark, d), "action")


def spearman_sql(x: str, y: str, source: str) -> str:
    def ranks(c):
        return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"
    return f"SELECT corr(rx, ry) AS spearman FROM (SELECT {ranks(x)} AS rx, {ranks(y)} AS ry FROM {source})"


@query("e14_spearman", rnd(spearman_sql("l_quantity", "l_extendedprice", "lineitem"), "spearman"))
def _(spark, d):
    return E.spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


# Pseudo-coordinates from the keys, the same in both engines.
CUSTOMER_POINTS = ("SELECT c_custkey AS location_id, (c_custkey * 37 % 1200) / 100.0 + 40 AS latitude, (c_custkey * 61 % 1500) / 100.0 - 5 AS longitude, "
                   "1 + c_acctbal / 1000 AS weight FROM customer")
SUPPLIER_POINTS = ("SELECT s_suppkey AS location_id, (s_suppkey * 37 % 1200) / 100.0 + 40 AS latitude, (s_suppkey * 61 % 1500) / 100.0 - 5 AS longitude FROM supplier")


def points(spark, d, table, key):
    k = F.col(key)
    cols = [k.alias("location_id"), ((k * 37 % 1200) / 100.0 + 40).alias("latitude"), ((k * 61 % 1500) / 100.0 - 5).alias("longitude")]
    if table == "customer":
        cols.append((1 + F.col("c_acctbal") / 1000).alias("weight"))
    return load(spark, d, table).select(*cols)


@query("e15_geographic_coverage", rnd(
    f"WITH c AS (SELECT DISTINCT floor(latitude) AS a, floor(longitude) AS b FROM ({CUSTOMER_POINTS})), s AS (SELECT DISTINCT floor(latitude) AS a, floor(longitude) AS b FROM ({SUPPLIER_POINTS})) "
    "SELECT count(s.a) * 1.0 / count(*) AS coverage FROM c LEFT JOIN s ON c.a = s.a AND c.b = s.b", "coverage"))
def _(spark, d):
    return E.geographic_coverage(points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey"), "latitude", "longitude")


CLASSIFIED = ("SELECT lang, source, quality AS label, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
CLASS_SQL = ("count(*) AS n, avg((label = predicted)::INTEGER) AS accuracy, "
             "CASE WHEN sum(predicted) > 0 THEN sum(label * predicted) / sum(predicted)::DOUBLE END AS precision, "
             "CASE WHEN sum(label) > 0 THEN sum(label * predicted) / sum(label)::DOUBLE END AS recall, "
             "CASE WHEN sum(label) + sum(predicted) > 0 THEN 2 * sum(label * predicted) / (sum(label) + sum(predicted))::DOUBLE END AS f1")


def classified(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(
        "lang", "source", F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted"))


@query("e16_classification_metrics", rnd(f"SELECT {CLASS_SQL} FROM ({CLASSIFIED})", "accuracy", "precision", "recall", "f1"))
def _(spark, d):
    return E.classification_metrics(classified(spark, d), "label", "predicted")


@query("e16_classification_by_source", rnd(f"SELECT source, {CLASS_SQL} FROM ({CLASSIFIED}) GROUP BY source", "accuracy", "precision", "recall", "f1"))
def _(spark, d):
    return E.classification_metrics(classified(spark, d), "label", "predicted", ["source"])


@query("e17_sliced_metrics", rnd(
    f"WITH p AS ({PREDICTED}) SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n, {MEASURE_SQL} FROM p WHERE l_returnflag IN ('A', 'R') GROUP BY 2 "
    f"UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), {MEASURE_SQL} FROM p GROUP BY 2 "
    f"UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), {MEASURE_SQL} FROM p GROUP BY 2", *MEASURES))
def _(spark, d):
    return E.sliced_metrics(predicted(spark, d), "y", "f", ["l_returnflag", "l_linestatus", "l_linenumber"], {"l_returnflag": ["A", "R"]})


def as_metric_rows(df):
    return df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in MEASURES])))


MODEL_ROWS = each(f"SELECT '{{c}}' AS metric, {{c}} AS value FROM (SELECT {MEASURE_SQL} FROM ({PREDICTED}))", MEASURES)
NAIVE = PREDICTED.replace("l_quantity * p_retailprice * (1 + l_discount)", "l_quantity * 1000.0")
COMPARE_SQL = (f"WITH m AS ({MODEL_ROWS}), b AS ({each(f'SELECT {chr(39)}{{c}}{chr(39)} AS metric, {{c}} AS reference FROM (SELECT {MEASURE_SQL} FROM ({NAIVE}))', MEASURES)}), "
               "c AS (SELECT m.metric, value, reference, value - reference AS delta, (value - reference) / abs(reference) AS relative_delta FROM m JOIN b ON m.metric = b.metric) ")


def comparison(spark, d):
    model = as_metric_rows(E.regression_metrics(predicted(spark, d), "y", "f"))
    base = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("f"))
    return E.compare_runs(model, as_metric_rows(E.regression_metrics(base, "y", "f")))


@query("e18_compare_runs", rnd(COMPARE_SQL + "SELECT * FROM c", "value", "reference", "delta", "relative_delta"))
def _(spark, d):
    return comparison(spark, d)


@query("e19_economic_value", rnd(
    COMPARE_SQL + "SELECT metric, delta, 10000.0::DOUBLE AS dollar_per_unit, delta * 10000 AS economic_value FROM c WHERE metric = 'mape'",
    "delta", "dollar_per_unit", "economic_value"))
def _(spark, d):
    mapping = literal_table(spark, [("mape", 10000.0)], "metric string, dollar_per_unit double")
    return E.economic_value(comparison(spark, d), mapping).select("metric", "delta", "dollar_per_unit", "economic_value")


# --- features ---------------------------------------------------------------

@query("f1_lag_features", rnd(
    "SELECT user_id, ts AS t, event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, "
    "avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7 "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "value", "lag_1", "lag_7", "rolling_mean_7").replace("ts AS t, ", ""))
def _(spark, d):
    return FT.lag_features(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query("f2_calendar_features", rnd(
    "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, "
    "dayofweek(o_orderdate) IN (0, 6) AS is_weekend, sin(2 * pi() * (month(o_orderdate) - 1) / 12) AS month_sin, cos(2 * pi() * (month(o_orderdate) - 1) / 12) AS month_cos FROM orders",
    "month_sin", "month_cos"))
def _(spark, d):
    return FT.calendar_features(load(spark, d, "orders"), "o_orderdate").select(
        "o_orderkey", "day_of_week", "month", "quarter", "is_weekend", "month_sin", "month_cos")


DAILY = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS value FROM events GROUP BY 1, 2"


def daily(spark, d):
    return load(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("value"))


@query("f3_seasonal_naive", rnd(
    f"WITH s AS ({DAILY}), f AS (SELECT *, lag(value, 7) OVER (PARTITION BY event_type ORDER BY day) AS forecast FROM s), "
    "r AS (SELECT *, stddev_samp(value - forecast) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM f) "
    "SELECT event_type, day, value, forecast, forecast - 1.2816 * sd AS lower_bound, forecast + 1.2816 * sd AS upper_bound FROM r",
    "value", "forecast", "lower_bound", "upper_bound"))
def _(spark, d):
    return FT.seasonal_naive(daily(spark, d), ["event_type"], "day", "value")


@query("f4_behaviour_features", rnd(
    "SELECT user_id, CAST(datediff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') AS INTEGER) AS recency_days, avg((event_type = 'purchase')::INTEGER) AS propensity, "
    "avg(value) AS mean_value, avg((event_type = 'purchase')::INTEGER) * avg(value) AS propensity_value FROM events GROUP BY user_id", "propensity", "mean_value", "propensity_value"))
def _(spark, d):
    return FT.behaviour_features(load(spark, d, "events"), "user_id", "ts", "event_type", "purchase", "value", "2024-01-31")


HAVERSINE = ("2 * 6371.0 * asin(sqrt(pow(sin(radians(c.latitude - s.latitude) / 2), 2) + cos(radians(s.latitude)) * cos(radians(c.latitude)) * "
             "pow(sin(radians(c.longitude - s.longitude) / 2), 2)))")


@query("f5_trade_area", rnd(
    f"WITH s AS ({SUPPLIER_POINTS}), c AS ({CUSTOMER_POINTS}), n AS (SELECT s.location_id, c.weight, {HAVERSINE} AS d FROM s, c WHERE {HAVERSINE} <= 80), "
    "g AS (SELECT location_id, count(*) AS k, sum(weight / (1 + d * d)) AS gr FROM n GROUP BY 1) "
    "SELECT s.location_id, coalesce(k, 0) AS competitors, coalesce(gr, 0) AS gravity FROM s LEFT JOIN g ON s.location_id = g.location_id", "gravity"))
def _(spark, d):
    return FT.trade_area(points(spark, d, "supplier", "s_suppkey"), points(spark, d, "customer", "c_custkey"), 80.0)


PRODUCTS = "SELECT p_partkey AS product_id, p_retailprice AS base_price, p_retailprice * 0.6 AS unit_cost, 100.0 AS base_quantity, -1.0 - p_size / 20.0 AS elasticity FROM part"


@query("f6_optimal_price", rnd(
    f"WITH c AS (SELECT p.*, i, 0.85 + i * ((1.25 - 0.85) / 40) AS m FROM ({PRODUCTS}) p, range(41) r(i)), "
    "g AS (SELECT *, round((base_price * m - unit_cost) * base_quantity * pow(m, elasticity), 6) AS margin FROM c) "
    "SELECT product_id, max_by(base_price * m, (margin, -i)) AS optimal_price, max_by(m, (margin, -i)) AS multiplier, max(margin) AS expected_margin FROM g GROUP BY product_id",
    "optimal_price", "multiplier", "expected_margin"))
def _(spark, d):
    p = load(spark, d, "part")
    return FT.optimal_price(p.select(
        F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("base_price"), (F.col("p_retailprice") * 0.6).alias("unit_cost"),
        F.lit(100.0).alias("base_quantity"), (-1.0 - F.col("p_size") / 20.0).alias("elasticity")))


@query("f7_time_splits",
       "WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS z FROM orders), f AS (SELECT i, z - CAST(30 * (6 - i) AS INTEGER) AS cut FROM e, range(1, 6) r(i)), "
       "r AS (SELECT i AS fold, CASE WHEN CAST(o_orderdate AS DATE) <= cut THEN 'train' WHEN CAST(o_orderdate AS DATE) <= cut + 30 THEN 'test' END AS role FROM orders, f) "
       "SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return FT.time_splits(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"))


def hashed_sql(*keys: str) -> str:
    return f"CAST('0x' || substring(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("f7_stratified_holdout",
       f"SELECT o_orderpriority, {hashed_sql('o_orderpriority', 'o_orderkey')} < 0.2::DOUBLE AS is_test, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return FT.stratified_holdout(load(spark, d, "orders"), ["o_orderpriority"], "o_orderkey").groupBy("o_orderpriority", "is_test").agg(
        F.count(F.lit(1)).alias("n"))


@query("f7_spatial_folds",
       f"SELECT location_id, CAST((CAST(floor(latitude) AS BIGINT) * 31 + CAST(floor(longitude) AS BIGINT) * 17) % 5 + "
       "CASE WHEN (CAST(floor(latitude) AS BIGINT) * 31 + CAST(floor(longitude) AS BIGINT) * 17) % 5 < 0 THEN 5 ELSE 0 END AS INTEGER) AS fold FROM "
       f"({CUSTOMER_POINTS})")
def _(spark, d):
    return FT.spatial_folds(points(spark, d, "customer", "c_custkey"), "latitude", "longitude").select("location_id", "fold")


@query("f8_uplift_facts", "SELECT count(*) AS row_count, count(*) AS scored, count(*) AS differences, true AS in_range FROM orders")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("treated", F.col("o_custkey") % 2 == 0)
    scores = M.uplift_scores(orders, ["o_orderstatus", "o_orderpriority"], "treated", "o_totalprice", ["o_orderkey"], trees=5)
    low, high = orders.agg(F.min("o_totalprice")).scalar(), orders.agg(F.max("o_totalprice")).scalar()
    # Forests average training values, so scores lie between the least and the greatest of them.
    inside = F.col("score_treated").between(F.col("a"), F.col("z")) & F.col("score_control").between(F.col("a"), F.col("z"))
    return scores.withColumns({"a": low, "z": high}).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("score_treated").isNotNull() & F.col("score_control").isNotNull()).alias("scored"),
        F.count_if(F.abs(F.col("uplift") - (F.col("score_treated") - F.col("score_control"))) < 1e-6).alias("differences"),
        F.bool_and(inside).alias("in_range"))


@query("f8_uplift_scores")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("treated", F.col("o_custkey") % 2 == 0)
    return M.uplift_scores(orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], "treated", "o_totalprice", ["o_orderkey"], trees=10)


CHECKS = {
    "price_bounds": "l_extendedprice BETWEEN 1000 AND 90000", "negative_values": "l_quantity >= 0 AND l_tax >= 0",
    "missing_features": "l_partkey IS NOT NULL AND l_shipdate IS NOT NULL", "discount_bounds": "l_discount <= 0.08"}


@query("f9_pipeline_checks", rnd(
    " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE NOT ({c})) AS violations, count(*) FILTER (WHERE NOT ({c})) / count(*)::DOUBLE AS violation_rate, "
                       f"count(*) FILTER (WHERE NOT ({c})) = 0 AS passed FROM lineitem" for n, c in CHECKS.items()), "violation_rate"))
def _(spark, d):
    return FT.pipeline_checks(load(spark, d, "lineitem"), {n: F.expr(c) for n, c in CHECKS.items()})


@query("f9_coordinate_validity", rnd(
    f"SELECT 'coordinate_validity' AS \"check\", count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)) AS violations, "
    f"0.0::DOUBLE AS violation_rate, true AS passed FROM ({CUSTOMER_POINTS})", "violation_rate"))
def _(spark, d):
    return FT.pipeline_checks(points(spark, d, "customer", "c_custkey"), {
        "coordinate_validity": F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)})


@query("f9_balance_checks", rnd(
    f"SELECT 'label_balance' AS \"check\", avg(positive) AS share, avg(positive) BETWEEN 0.1 AND 0.9 AS passed FROM ({SCORED}) UNION ALL "
    f"SELECT 'treatment_control_split', avg(treated::INTEGER), avg(treated::INTEGER) BETWEEN 0.1 AND 0.9 FROM ({SCORED})", "share"))
def _(spark, d):
    return FT.balance_checks(scored(spark, d), F.col("positive") == 1, F.col("treated"))


# --- drift and monitoring -------------------------------------------------------

FEATURES = ["value", "user_id"]
REF = "ts < TIMESTAMP '2024-01-16 00:00:00'"


def is_reference():
    return F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")


def psi_sql(c: str) -> str:
    edges = ", ".join(f"quantile_cont({c}::DOUBLE, {i / 10}) AS e{i}" for i in range(1, 10))
    number = " + ".join(f"({c} > e{i})::INTEGER" for i in range(1, 10))
    return (f"SELECT '{c}' AS feature, sum((cu - re) * ln(cu / re)) AS psi, sum((cu - re) * ln(cu / re)) > 0.2 AS drifted FROM ("
            f"SELECT b, greatest(count(*) FILTER (WHERE NOT r) / (SELECT count(*) FROM events WHERE NOT ({REF}))::DOUBLE, 1e-6) AS cu, "
            f"greatest(count(*) FILTER (WHERE r) / (SELECT count(*) FROM events WHERE {REF})::DOUBLE, 1e-6) AS re FROM "
            f"(SELECT {number} AS b, {REF} AS r FROM events, (SELECT {edges} FROM events WHERE {REF})) GROUP BY b)")


def ks_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, max(g) AS ks, max(g) > 0.1 AS drifted FROM (SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(k) OVER w / sum(k) OVER ()) AS g FROM "
            f"(SELECT {c} AS v, count(*) FILTER (WHERE {REF})::DOUBLE AS r, count(*) FILTER (WHERE NOT ({REF}))::DOUBLE AS k FROM events GROUP BY 1) WINDOW w AS (ORDER BY v))")


@query("r1_psi", rnd(" UNION ALL ".join(psi_sql(c) for c in FEATURES), "psi"))
def _(spark, d):
    return R.psi(load(spark, d, "events"), FEATURES, is_reference())


@query("r2_ks", rnd(" UNION ALL ".join(ks_sql(c) for c in FEATURES), "ks"))
def _(spark, d):
    return R.ks(load(spark, d, "events"), FEATURES, is_reference())


@query("r3_freshness", rnd(
    "SELECT event_type, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts))) / 3600 AS age_hours, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts))) / 3600 > 0.4 AS is_stale "
    "FROM events GROUP BY event_type", "age_hours"))
def _(spark, d):
    return R.freshness(load(spark, d, "events"), "ts", "2024-01-31 00:00:00", 0.4, ["event_type"])


CONDITIONS = [("MAPE", ">", 0.3, "high"), ("RMSE", ">=", 25.0, "medium"), ("forecast_bias", "<", 0.01, "low")]


@query("r4_alerts", rnd(
    f"WITH r AS ({RUNS_DUCK}) " + " UNION ALL ".join(
        f"SELECT run_id AS subject, '{m}' AS metric, {m} AS value, '{op}' AS op, {t}::DOUBLE AS threshold, '{s}' AS severity FROM r WHERE {m} {op} {t}" for m, op, t, s in CONDITIONS),
    "value", "threshold"))
def _(spark, d):
    metrics = runs(spark, d).select(F.col("run_id").alias("subject"), F.explode("metrics").alias("metric", "value"))
    conditions = literal_table(spark, CONDITIONS, "metric string, op string, threshold double, severity string")
    return R.alerts(metrics, conditions)


@query("r5_monitor_snapshot", rnd(
    f"WITH p AS ({' UNION ALL '.join(psi_sql(c) for c in FEATURES)}), k AS ({' UNION ALL '.join(ks_sql(c) for c in FEATURES)}), "
    f"m AS (SELECT {MEASURE_SQL} FROM ({PREDICTED})) "
    "SELECT 'unit_price' AS model_id, '2024-01-31' AS captured_at, mape, (SELECT max(psi) FROM p) AS psi, (SELECT max(ks) FROM k) AS ks_stat, "
    "(SELECT count(DISTINCT feature) FROM (SELECT feature FROM p WHERE drifted UNION ALL SELECT feature FROM k WHERE drifted)) AS feature_drift_count, "
    "(SELECT floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts))) / 3600 FROM events) AS age_hours, "
    "(SELECT floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts))) / 3600 > 24 FROM events) AS is_stale, CAST(CASE WHEN mape > 0.3 THEN 1 ELSE 0 END AS BIGINT) AS alert_count FROM m",
    "mape", "psi", "ks_stat", "age_hours"))
def _(spark, d):
    events = load(spark, d, "events")
    performance = as_metric_rows(E.regression_metrics(predicted(spark, d), "y", "f"))
    conditions = literal_table(spark, [("mape", ">", 0.3, "high")], "metric string, op string, threshold double, severity string")
    snapshot = R.monitor_snapshot(
        "unit_price", "2024-01-31", performance, R.psi(events, FEATURES, is_reference()), R.ks(events, FEATURES, is_reference()),
        R.freshness(events, "ts", "2024-01-31 00:00:00", 24), R.alerts(performance, conditions))
    return snapshot.withColumn("mape", F.try_element_at("performance", F.lit("mape"))).drop("performance")


# Users are runs; their event types stand for states.
STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"


def run_events(spark, d):
    return load(spark, d, "events").select(F.col("user_id").alias("run_id"), F.expr(STATES).alias("state"), F.col("ts").alias("event_at"))


@query("r5_list_snapshots", rnd(
    "SELECT day AS captured_at, age_hours FROM (SELECT day, (SELECT floor(epoch(CAST(day AS TIMESTAMP) - max(ts))) / 3600 FROM events) AS age_hours "
       "FROM (VALUES ('2024-02-01'), ('2024-02-03'), ('2024-02-02')) v(day))", "age_hours"))
def _(spark, d):
    path, events = scratch_path(spark, "snapshots"), load(spark, d, "events")
    for model, day in (("price", "2024-02-01"), ("price", "2024-02-03"), ("other", "2024-02-04"), ("price", "2024-02-02")):
        kept = R.append_snapshot(R.freshness(events, "ts", f"{day} 00:00:00", 24).select(
            F.lit(model).alias("model_id"), F.lit(day).alias("captured_at"), "age_hours"), path)
    return R.list_snapshots(kept, "price").select("captured_at", "age_hours")


@query("r6_run_timeline",
       f"WITH e AS (SELECT user_id AS run_id, {STATES} AS state, ts FROM events), t AS (SELECT run_id, min(ts) FILTER (WHERE state = 'running') AS a, "
       "max(ts) FILTER (WHERE state IN ('succeeded', 'failed')) AS z, max_by(state, ts) AS status FROM e GROUP BY 1) "
       "SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(z, '%Y-%m-%d %H:%M:%S') AS finished_at, status, CAST(floor(epoch(z - a)) AS BIGINT) AS duration_seconds FROM t")
def _(spark, d):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return R.run_timeline(run_events(spark, d)).withColumns({
        "started_at": F.date_format("started_at", stamp), "finished_at": F.date_format("finished_at", stamp)})


@query("r6_success_rate", rnd(
    f"WITH e AS (SELECT user_id AS run_id, {STATES} AS state, ts FROM events), t AS (SELECT run_id, max_by(state, ts) AS status FROM e GROUP BY 1) "
    "SELECT count(*) AS runs, count(*) FILTER (WHERE status IN ('succeeded', 'failed')) AS ended, "
    "count(*) FILTER (WHERE status = 'succeeded') / count(*) FILTER (WHERE status IN ('succeeded', 'failed'))::DOUBLE AS success_rate FROM t", "success_rate"))
def _(spark, d):
    return R.success_rate(R.run_timeline(run_events(spark, d)))


@query("r7_latest_versions", f"SELECT pack_id AS recipe_id, max(version) AS version, max_by(content, version) AS content FROM ({VERSIONS}) GROUP BY 1")
def _(spark, d):
    return E.latest_versions(versions(spark, d), "pack_id").withColumn("version", F.col("version").cast("bigint")).withColumnRenamed("pack_id", "recipe_id")


@query("r7_inheritance_chain",
       "WITH RECURSIVE c(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey * 2 >= (SELECT count(*) FROM part) UNION "
       "SELECT node // 3, depth + 1 FROM c WHERE node > 0) SELECT 'r' || node AS node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY node")
def _(spark, d):
    # Recipe k inherits from recipe k // 3; the chain starts at the later half of the parts.
    parts = load(spark, d, "part").select("p_partkey")
    edges = parts.filter("p_partkey > 0").select(
        F.concat(F.lit("r"), "p_partkey").alias("source"), F.concat(F.lit("r"), F.floor(F.col("p_partkey") / 3)).alias("target"))
    half = parts.agg(F.count(F.lit(1))).scalar()
    start = parts.filter(F.col("p_partkey") * 2 >= half).select(F.concat(F.lit("r"), "p_partkey").alias("node"))
    return X.lineage(edges, start, "downstream")
