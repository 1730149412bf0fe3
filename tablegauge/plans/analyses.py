"""Deep analyses, synthetic data, predictive models, sources and streams."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablegauge.operators import deep as N
from tablegauge.operators import predict as M
from tablegauge.operators import synthetic as Y
from tablegauge.plans.models import REF, hashed_sql, is_reference, spearman_sql
from tablegauge.plans.registry import each, load, query, rnd
from tablegauge.plans.reports import LINE_NUM, NEGATIVE_SQL, OUT, duplicates_sql, outliers_sql
from tablegauge.plans.views import SALES_SQL, flags, sales
from tablegauge.session import materialize, scratch_path
from tablegauge.sources import files, rows
from tablegauge.streaming import streams as W

# --- deep analyses --------------------------------------------------------------

RULES = [
    {"kind": "duplicates"},
    {"kind": "invalid_values", "column": "l_returnflag", "allowed": ["A", "R"]},
    {"kind": "range_violation", "column": "l_quantity", "low": 2, "high": 49},
    {"kind": "format_violation", "column": "l_linestatus", "pattern": "^O$"},
    {"kind": "schema_mismatch", "column": "l_quantity", "type": "int"},
    {"kind": "missing_data", "column": "l_tax"},
]


def rule_sql(kind: str, column: str | None, count: str) -> str:
    c = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{kind}' AS type, {c} AS column_name, {count} AS violations, count(*) AS n FROM lineitem"


@query("n1_quality_rules", rnd(
    "WITH v AS (" + " UNION ALL ".join([
        rule_sql("duplicates", None, duplicates_sql("(SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem)")),
        rule_sql("invalid_values", "l_returnflag", "count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R'))"),
        rule_sql("range_violation", "l_quantity", "count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49)"),
        rule_sql("format_violation", "l_linestatus", "count(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^O$'))"),
        rule_sql("schema_mismatch", "l_quantity", "count(*)"),
        rule_sql("missing_data", "l_tax", "count(*) - count(l_tax)")])
    + ") SELECT type, column_name, violations, violations / n::DOUBLE AS rate, CASE WHEN violations / n::DOUBLE > 0.1 THEN 'high' WHEN violations / n::DOUBLE > 0.01 THEN 'medium' "
      "ELSE 'low' END AS severity FROM v WHERE violations > 0", "rate"))
def _(spark, d):
    return N.quality_rules(flags(spark, d), RULES)


@query("n2_outlier_magnitude", rnd(
    f"WITH v AS ({NEGATIVE_SQL}), w AS (SELECT value, user_id FROM events) SELECT * FROM (" + outliers_sql(
        ["revenue", "price", "quantity"], "v", "'{c}' AS column_name, " + OUT + " AS outlier_count, " + OUT + " / count(*)::DOUBLE AS frequency, "
        "max(abs({c})) FILTER (WHERE {c} < lo OR {c} > hi) / abs(quantile_cont({c}::DOUBLE, 0.5)) AS magnitude")
    + " UNION ALL " + outliers_sql(["value", "user_id"], "w", "'{c}' AS column_name, " + OUT + " AS outlier_count, " + OUT + " / count(*)::DOUBLE AS frequency, "
                                   "max(abs({c})) FILTER (WHERE {c} < lo OR {c} > hi) / abs(quantile_cont({c}::DOUBLE, 0.5)) AS magnitude")
    + ") WHERE outlier_count > 0", "frequency", "magnitude"))
def _(spark, d):
    lines = load(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 900 * F.col("l_quantity")).alias("revenue"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return N.outlier_magnitude(lines).unionByName(N.outlier_magnitude(load(spark, d, "events").select("value", "user_id")))


@query("n3_category_surprise",
       f"WITH e AS (SELECT event_type || '-' || CAST(floor(value / 20) AS BIGINT) AS category, {REF} AS r FROM events) "
       "SELECT category, count(*) AS row_count FROM e GROUP BY category HAVING count(*) FILTER (WHERE r) = 0")
def _(spark, d):
    e = load(spark, d, "events").withColumn("category", F.concat_ws("-", "event_type", F.floor(F.col("value") / 20)))
    return N.category_surprise(e, "category", is_reference())


HOURLY = "SELECT date_trunc('hour', ts) AS bucket, count(*) AS value FROM events GROUP BY 1"


def hourly(spark, d):
    return N.bucket_series(load(spark, d, "events"), "ts", "hour", F.count(F.lit(1)))


def weekly_orders(spark, d):
    return N.bucket_series(load(spark, d, "orders"), "o_orderdate", "week", F.sum("o_totalprice"))


WEEKLY = "SELECT date_trunc('week', o_orderdate) AS bucket, sum(o_totalprice) AS value FROM orders GROUP BY 1"


@query("n4_spikes", rnd(
    f"WITH s AS ({HOURLY}), t AS (SELECT bucket, value, avg(value) OVER w AS trailing_mean, stddev_samp(value) OVER w AS sd, count(*) OVER w AS k FROM s "
    "WINDOW w AS (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) "
    "SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, value, trailing_mean, (value - trailing_mean) / sd AS z_score, CASE WHEN value > trailing_mean THEN 'spike' ELSE 'drop' END AS type "
    "FROM t WHERE k = 7 AND sd > 0 AND abs((value - trailing_mean) / sd) > 3", "trailing_mean", "z_score"))
def _(spark, d):
    return N.spikes(hourly(spark, d)).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]


@query("n5_correlation_kinds", rnd(
    "WITH p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, (SELECT corr({a}, {b}) FROM lineitem) AS pearson, ({spearman_sql(a, b, 'lineitem')}) AS spearman" for a, b in PAIRS)
    + ") SELECT *, CASE WHEN abs(spearman) - abs(pearson) > 0.2 THEN 'non_linear' WHEN pearson > 0.5 THEN 'positive_correlation' WHEN pearson < -0.5 THEN 'negative_correlation' ELSE 'none' END AS type FROM p",
    "pearson", "spearman"))
def _(spark, d):
    return N.correlation_kinds(load(spark, d, "lineitem"), PAIRS)


@query("n5_segment_difference", rnd(
    f"WITH v AS ({SALES_SQL}), g AS (SELECT region, count(*) AS n, avg(sales) AS m FROM v GROUP BY 1) "
    "SELECT 'region' AS segment, 'sales' AS metric, (SELECT count(*) FROM g) AS groups, (SELECT sum(n * (m - (SELECT avg(sales) FROM v)) * (m - (SELECT avg(sales) FROM v))) FROM g) / "
    "(SELECT var_pop(sales) * count(*) FROM v) AS eta_squared", "eta_squared", digits=6), digits=6)
def _(spark, d):
    return N.segment_difference(sales(spark, d), "region", "sales")


@query("n5_categorical_association", rnd(
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), "
    "k AS (SELECT b, sum(n) AS k FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), "
    "x AS (SELECT sum((coalesce(n, 0) - r * k / t) * (coalesce(n, 0) - r * k / t) / (r * k / t)) AS x2 FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b) "
    "SELECT 'o_orderstatus' AS column1, 'o_orderpriority' AS column2, sqrt(x2 / ((SELECT t FROM t) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))) AS cramers_v FROM x",
    "cramers_v"))
def _(spark, d):
    return N.categorical_association(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("n6_trend_type", rnd(
    f"WITH s AS ({WEEKLY}), i AS (SELECT value, (row_number() OVER (ORDER BY bucket) - 1)::DOUBLE AS i, count(*) OVER () AS n FROM s), "
    "r AS (SELECT count(*) AS buckets, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2, regr_slope(value, i) * (count(*) - 1) / abs(avg(value)) AS relative_change, "
    "regr_slope(value, i) FILTER (WHERE i < n // 2) AS a, regr_slope(value, i) FILTER (WHERE i >= n // 2) AS z FROM i) "
    "SELECT buckets, slope, r2, relative_change, CASE WHEN r2 < 0.1 THEN CASE WHEN a * z < 0 THEN 'mixed' ELSE 'unclear' END WHEN abs(relative_change) < 0.05 THEN 'stable' "
    "WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_type FROM r", "slope", "r2", "relative_change"))
def _(spark, d):
    return N.trend_type(weekly_orders(spark, d))


@query("n7_change_point", rnd(
    f"WITH s AS ({WEEKLY}), p AS (SELECT bucket, count(*) OVER w AS k, sum(value) OVER w AS s, count(*) OVER () AS n, sum(value) OVER () AS t FROM s WINDOW w AS (ORDER BY bucket)), "
    "g AS (SELECT *, s / k AS mb, (t - s) / (n - k) AS ma FROM p WHERE k >= 5 AND n - k >= 5), b AS (SELECT *, k * (n - k) / n::DOUBLE * (mb - ma) * (mb - ma) AS e FROM g) "
    "SELECT strftime(bucket, '%Y-%m-%d') AS bucket, mb AS mean_before, ma AS mean_after, sqrt(e) AS error_reduction FROM b ORDER BY e DESC, k LIMIT 1", "mean_before", "mean_after", "error_reduction", digits=3), digits=3)
def _(spark, d):
    return N.change_point(weekly_orders(spark, d)).withColumns({
        "bucket": F.date_format("bucket", "yyyy-MM-dd"), "error_reduction": F.sqrt("error_reduction")})


# Shipped quantities are even over time; a price index by year gives them levels that shift.
SHIPPED = "SELECT date_trunc('week', l_shipdate) AS bucket, CAST(sum(l_quantity) * (100 + 25 * (year(date_trunc('week', l_shipdate)) % 3)) AS DOUBLE) AS value FROM lineitem GROUP BY 1"


# Every segment of the recursion is searched for its best split; its sides are segments if the split is accepted.
@query("n7_change_points", rnd(
    f"WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY bucket) AS i, bucket, value AS v FROM ({SHIPPED})), "
    "p AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS bucket, CAST(0 AS DOUBLE) AS s UNION ALL SELECT i, bucket, sum(v) OVER (ORDER BY i) FROM x), "
    "c AS (SELECT 3.0 * ln(count(*)) * avg((v - w) * (v - w)) / 2 AS bar, count(*) AS n FROM (SELECT v, lag(v) OVER (ORDER BY i) AS w FROM x)), "
    "g AS (SELECT CAST(0 AS BIGINT) AS lo, n AS hi, 1 AS round FROM c UNION ALL SELECT unnest([lo, i]) AS lo, unnest([i, hi]) AS hi, round + 1 AS round FROM ("
    "SELECT lo, hi, round, arg_max(i, e) AS i, max(e) AS e FROM (SELECT g.*, p.i, (p.i - lo) * (hi - p.i) / (hi - lo)::DOUBLE * pow((p.s - a.s) / (p.i - lo) - (z.s - p.s) / (hi - p.i), 2) AS e "
    "FROM g JOIN p a ON a.i = lo JOIN p z ON z.i = hi JOIN p ON p.i >= lo + 5 AND p.i <= hi - 5) GROUP BY lo, hi, round) WHERE e > (SELECT bar FROM c)), "
    "f AS (SELECT lo, hi, round, arg_max(i, e) AS position, max(e) AS e FROM (SELECT g.*, p.i, (p.i - lo) * (hi - p.i) / (hi - lo)::DOUBLE * pow((p.s - a.s) / (p.i - lo) - (z.s - p.s) / (hi - p.i), 2) AS e "
    "FROM g JOIN p a ON a.i = lo JOIN p z ON z.i = hi JOIN p ON p.i >= lo + 5 AND p.i <= hi - 5) GROUP BY lo, hi, round) "
    "SELECT strftime(p.bucket, '%Y-%m-%d') AS bucket, position, lo AS segment_start, hi AS segment_end, (p.s - a.s) / (position - lo) AS mean_before, (z.s - p.s) / (hi - position) AS mean_after, "
    "sqrt(e) AS error_reduction, round FROM f JOIN p ON p.i = position JOIN p a ON a.i = lo JOIN p z ON z.i = hi WHERE e > (SELECT bar FROM c)",
    "mean_before", "mean_after", "error_reduction", digits=3), digits=3)
def _(spark, d):
    weekly = N.bucket_series(load(spark, d, "lineitem"), "l_shipdate", "week", F.sum("l_quantity"))
    priced = weekly.withColumn("value", (F.col("value") * (100 + 25 * (F.year("bucket") % 3))).cast("double"))
    return N.change_points(priced).withColumns({
        "bucket": F.date_format("bucket", "yyyy-MM-dd"), "error_reduction": F.sqrt("error_reduction")})


LAGS = [2, 7, 24, 60, 168, 300]


@query("n8_block_autocorrelation", rnd(
    f"WITH i AS (SELECT row_number() OVER (ORDER BY bucket) AS i, value - avg(value) OVER () AS x FROM ({HOURLY})) "
    f"SELECT CAST(lag AS INTEGER) AS lag, sum(p.x * q.x) / (SELECT sum(x * x) FROM i) AS autocorrelation FROM (SELECT unnest({LAGS}) AS lag) l JOIN i p ON true "
    "JOIN i q ON q.i = p.i + l.lag GROUP BY 1", "autocorrelation"))
def _(spark, d):
    # Small blocks, so that lags reach from within a block to several blocks on.
    return N.block_autocorrelations(hourly(spark, d), LAGS, block=64)


@query("n8_seasonality", rnd(
    f"WITH s AS ({HOURLY}), i AS (SELECT row_number() OVER (ORDER BY bucket) AS i, value - avg(value) OVER () AS x, count(*) OVER () AS n FROM s), "
    "a AS (SELECT l.lag, sum(p.x * q.x) / (SELECT sum(x * x) FROM i) AS r FROM range(2, (SELECT count(*) // 2 + 1 FROM s)) l(lag) JOIN i p ON true JOIN i q ON q.i = p.i + l.lag GROUP BY 1) "
    "SELECT CAST(lag AS INTEGER) AS lag, r AS autocorrelation, r > 0.5 AS is_seasonal FROM a ORDER BY round(r, 9) DESC, lag LIMIT 1", "autocorrelation"))
def _(spark, d):
    return N.seasonality(hourly(spark, d))


@query("n8_weekday_shares", rnd(
    "SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, count(*) AS n, count(*) / (SELECT count(*) FROM events)::DOUBLE AS share FROM events GROUP BY 1", "share"))
def _(spark, d):
    return N.weekday_shares(load(spark, d, "events"), "ts")


@query("n9_cluster_facts", "SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS rows_in_clusters, true AS shares_sum_to_one FROM lineitem")
def _(spark, d):
    found = N.clusters(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("rows_in_clusters"),
                     (F.abs(F.sum("prevalence") - 1) < 1e-9).alias("shares_sum_to_one"))


# Four groups far apart from each other: a segment for each, and no other partition of the rows has these sizes.
@query("n9_separated_clusters", rnd(
    "SELECT count(*) AS size, count(*) / sum(count(*)) OVER ()::DOUBLE AS prevalence FROM lineitem GROUP BY l_linenumber % 4", "prevalence"))
def _(spark, d):
    part = F.col("l_linenumber") % 4
    rows = load(spark, d, "lineitem").select((F.floor(part / 2) * 100 + F.col("l_tax")).alias("a"), (part % 2 * 100 + F.col("l_discount")).alias("b"))
    return N.clusters(rows, ["a", "b"]).select("size", "prevalence")


@query("n9_clusters")
def _(spark, d):
    return N.clusters(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


COMBO = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]


@query("n10_frequent_combinations", rnd(
    " UNION ALL ".join(
        f"SELECT '{a}' AS column1, CAST({a} AS VARCHAR) AS value1, '{b}' AS column2, CAST({b} AS VARCHAR) AS value2, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS support "
        f"FROM lineitem GROUP BY {a}, {b} HAVING count(*) >= 0.02 * (SELECT count(*) FROM lineitem)" for a, b in combinations(COMBO, 2)), "support"))
def _(spark, d):
    return N.frequent_combinations(load(spark, d, "lineitem"), COMBO, 0.02)


@query("n10_frequent_itemsets", rnd(
    " UNION ALL ".join(
        f"SELECT {len(part)} AS size, '{','.join(part)}' AS columns, {' || chr(32) || chr(38) || chr(32) || '.join(f'{chr(39)}{c}={chr(39)} || CAST({c} AS VARCHAR)' for c in part)} AS combination, "
        f"count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS support FROM lineitem GROUP BY {', '.join(part)} HAVING count(*) >= 0.01 * (SELECT count(*) FROM lineitem)"
        for k in range(2, len(COMBO) + 1) for part in combinations(COMBO, k)), "support"))
def _(spark, d):
    return N.frequent_itemsets(load(spark, d, "lineitem"), COMBO, 0.01)


DIMS = ["customer_segment", "region", "product_category"]


@query("n11_subpopulations", rnd(
    f"WITH v AS ({SALES_SQL}), o AS (SELECT count(sales) AS n, avg(sales) AS m, stddev_samp(sales) AS s FROM v), g AS ("
    + each("SELECT '{c}' AS dimension, {c} AS value, count(sales) AS size, avg(sales) AS mean FROM v GROUP BY {c}", DIMS)
    + ") SELECT dimension, value, size, mean, m AS overall_mean, (mean - m) / (s / sqrt(size)) AS z_score, size / n::DOUBLE AS share FROM g, o "
      "WHERE size / n::DOUBLE >= 0.01 AND abs((mean - m) / (s / sqrt(size))) >= 1.0 ORDER BY abs((mean - m) / (s / sqrt(size))) DESC",
    "mean", "overall_mean", "z_score", "share"))
def _(spark, d):
    return N.subpopulations(materialize(sales(spark, d), "sales"), DIMS, "sales", min_z=1.0)


# --- synthetic data ---------------------------------------------------------------

@query("y1_continuous_statistics", rnd(each(
    "SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}::DOUBLE) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem", LINE_NUM), "mean", "std", "min", "max"))
def _(spark, d):
    return Y.continuous_statistics(load(spark, d, "lineitem"), LINE_NUM)


@query("y2_value_frequencies", rnd(each(
    "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS probability FROM orders GROUP BY {c}",
    ["o_orderstatus", "o_orderpriority"]), "probability"))
def _(spark, d):
    return Y.frequencies(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("y3_synthesize")
def _(spark, d):
    return Y.synthesize(load(spark, d, "orders"), 1000, seed=3).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("y3_drawn_values", "SELECT CAST(5000 AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS outside_range, CAST(0 AS BIGINT) AS missing, o_orderstatus, true AS share_close FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    made = materialize(Y.synthesize(orders, 5000, seed=3), "drawn")
    low, high = orders.agg(F.min("o_totalprice")).scalar(), orders.agg(F.max("o_totalprice")).scalar()
    facts = made.withColumns({"a": low, "z": high}).agg(F.struct(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((F.col("o_totalprice") < F.col("a")) | (F.col("o_totalprice") > F.col("z"))).alias("outside_range"),
        F.count_if(F.col("o_totalprice").isNull() | F.col("o_orderstatus").isNull()).alias("missing"))).scalar()
    drawn = made.groupBy("o_orderstatus").agg((F.count(F.lit(1)) / 5000).alias("share"))
    wanted = Y.frequencies(orders, ["o_orderstatus"]).select(F.col("value").alias("o_orderstatus"), "probability")
    # Five standard deviations of a share of 5,000 draws at most; an unknown value shows as one more row.
    close = drawn.join(wanted, "o_orderstatus", "full").select(
        "o_orderstatus", (F.abs(F.coalesce("share", F.lit(0.0)) - F.col("probability")) < 0.036).alias("share_close"))
    return close.select(facts.alias("f"), "o_orderstatus", "share_close").select("f.*", "o_orderstatus", "share_close")


@query("y4_fidelity_bounds", "SELECT * FROM (VALUES ('o_custkey', true), ('o_totalprice', true)) v(column_name, fits)")
def _(spark, d):
    # A normal draw clipped to the range keeps the centre: far closer than any two different columns would be.
    orders = load(spark, d, "orders").select("o_totalprice", "o_custkey")
    made = Y.synthesize(orders, orders.count(), seed=5)
    fidelity = Y.synthetic_fidelity(orders, made, ["o_totalprice", "o_custkey"])
    return fidelity.select("column_name", ((F.col("quality_score") > 0.8) & (F.col("ks") < 0.2) & F.col("psi").isNotNull()).alias("fits"))


@query("y4_synthetic_fidelity")
def _(spark, d):
    orders = load(spark, d, "orders")
    made = Y.synthesize(orders.select("o_totalprice", "o_custkey"), orders.count(), seed=5)
    return Y.synthetic_fidelity(orders, made, ["o_totalprice", "o_custkey"])


# --- models ------------------------------------------------------------------------

@query("m1_encoded_features",
       "WITH l AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v, row_number() OVER (ORDER BY o_orderstatus) AS k FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL "
       "SELECT 'o_orderpriority', o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) FROM (SELECT DISTINCT o_orderpriority FROM orders)) "
       "SELECT c || '_' || v AS feature, CASE c WHEN 'o_orderstatus' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = v) ELSE (SELECT count(*) FROM orders WHERE o_orderpriority = v) END AS ones FROM l WHERE k > 1")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    orders = load(spark, d, "orders")
    encoded, names = M.encode_features(orders, ["o_orderstatus", "o_orderpriority"])
    slots = vector_to_array("features")
    totals = encoded.select(slots.alias("a")).agg(*[F.sum(F.col("a")[i]).cast("bigint").alias(f"s{i}") for i in range(len(names))])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"s{i}").alias("ones")) for i, n in enumerate(names)])))


@query("m2_choose_task",
       "SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus) AS distinct_values, 'classification' AS task FROM orders UNION ALL "
       "SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'regression' FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 'regression' FROM orders")
def _(spark, d):
    o = load(spark, d, "orders")
    parts = [M.choose_task(o, c, "classification") for c in ("o_orderstatus", "o_totalprice", "o_custkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m2_label_codes",
       "SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def _(spark, d):
    return M.label_codes(load(spark, d, "orders"), "o_orderpriority")


@query("m3_split_rows", f"SELECT o_orderkey, {hashed_sql('o_orderkey')} < 0.2::DOUBLE AS is_test FROM orders")
def _(spark, d):
    return M.split_rows(load(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query("m4_classifier_facts",
       f"WITH t AS (SELECT l_returnflag FROM lineitem WHERE {hashed_sql('l_orderkey', 'l_linenumber')} < 0.2::DOUBLE) "
       "SELECT 'l_returnflag' AS target, count(*) AS test_rows, true AS as_good_as_the_largest_class FROM t")
def _(spark, d):
    # The line status nearly gives the return flag away or not at all; either way the forest must not fall behind
    # the share of the most frequent class by more than a sampling error.
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_linestatus")
    metrics, _, _ = M.fit_classifier(li, "l_returnflag", ["l_orderkey", "l_linenumber"], trees=10, max_depth=4)
    most = li.groupBy("l_returnflag").count().agg(F.max("count") / F.sum("count")).scalar()
    return metrics.withColumn("share", most).select("target", "test_rows", (
        F.col("accuracy") >= F.col("share") - 3 / F.sqrt("test_rows")).alias("as_good_as_the_largest_class"))


# A class that quantity and return flag give away together: a constant prediction is right for about half of the rows.
@query("m4_learned_class",
       f"WITH t AS (SELECT 1 FROM lineitem WHERE {hashed_sql('l_orderkey', 'l_linenumber')} < 0.2::DOUBLE) "
       "SELECT 'handling' AS target, count(*) AS test_rows, true AS learned FROM t")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.when(
        F.col("l_quantity") <= 25, "small").when(F.col("l_returnflag") == "A", "claim").otherwise("bulk").alias("handling"))
    metrics, _, _ = M.fit_classifier(li, "handling", ["l_orderkey", "l_linenumber"], trees=20, max_depth=5)
    return metrics.select("target", "test_rows", (F.col("accuracy") > 0.9).alias("learned"))


@query("m5_regressor_facts",
       f"SELECT 'l_extendedprice' AS target, count(*) AS test_rows, true AS better_than_the_mean FROM lineitem WHERE {hashed_sql('l_orderkey', 'l_linenumber')} < 0.2::DOUBLE")
def _(spark, d):
    # The price grows with the quantity, which a forest must pick up.
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_quantity")).alias("gross"),
                                           "l_quantity", "l_extendedprice")
    metrics, _, _ = M.fit_regressor(li, "l_extendedprice", ["l_orderkey", "l_linenumber"], trees=10, max_depth=5)
    return metrics.select("target", "test_rows", (F.col("r2_score") > 0.3).alias("better_than_the_mean"))


@query("m6_importance_slots",
       "WITH l AS (SELECT 'o_orderstatus_' || o_orderstatus AS feature, row_number() OVER (ORDER BY o_orderstatus) AS k FROM (SELECT DISTINCT o_orderstatus FROM orders) "
       "UNION ALL SELECT 'o_orderpriority_' || o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) FROM (SELECT DISTINCT o_orderpriority FROM orders)), "
       "f AS (SELECT feature FROM l WHERE k > 1 UNION ALL SELECT 'o_custkey') SELECT feature, true AS is_share, true AS sums_to_one FROM f")
def _(spark, d):
    o = load(spark, d, "orders").drop("o_orderdate")
    found = M.fit_regressor(o, "o_totalprice", ["o_orderkey"], trees=10, max_depth=4)[1]
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"))


@query("m4_classifier")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus")
    return M.fit_classifier(li, "l_linestatus", ["l_orderkey", "l_linenumber"], max_depth=5)[0]


@query("m5_regressor")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    return M.fit_regressor(li, "l_extendedprice", ["l_orderkey", "l_linenumber"], max_depth=5)[0]


@query("m6_feature_importances")
def _(spark, d):
    o = load(spark, d, "orders").drop("o_orderdate")
    return M.fit_regressor(o, "o_totalprice", ["o_orderkey"], trees=20, max_depth=5)[1]


# --- sources -------------------------------------------------------------------------

@query("s1_csv_scan", rnd("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders", "o_totalprice"))
def _(spark, d):
    path = scratch_path(spark, "csv")
    load(spark, d, "orders").drop("o_orderdate").write.option("header", True).csv(path)
    return files.read_csv(spark, path).select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("s2_save_dataset", "SELECT sha256('orders') AS dataset_id, 'orders' AS filename, count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM orders UNION ALL "
                          "SELECT sha256('events'), 'events', count(*), CAST(6 AS INTEGER) FROM events")
def _(spark, d):
    root = scratch_path(spark, "store")
    files.save_dataset(load(spark, d, "orders"), "orders", root)
    return files.save_dataset(load(spark, d, "events"), "events", root).drop("created_at")


@query("s3_preview", rnd(
    "SELECT *, (SELECT count(*) FROM customer) AS row_count, CAST(5 AS INTEGER) AS column_count, "
    "'c_custkey: bigint, c_name: string, c_nationkey: int, c_acctbal: double, c_mktsegment: string' AS dtypes FROM customer ORDER BY c_custkey LIMIT 100", "c_acctbal"))
def _(spark, d):
    return rows.preview(load(spark, d, "customer"), 100, ["c_custkey"])


@query("s4_json_records", rnd("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, value, props FROM events", "value"))
def _(spark, d):
    path = scratch_path(spark, "json")
    load(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "value", "props").write.json(path)
    back = files.read_json_records(spark, path)
    return back.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "value", "props")


@query("s9_document_scan", "SELECT regexp_extract(url, '//([^/]+)', 1) AS host, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def _(spark, d):
    # The pages' own bytes go through the decoder; their host names the source.
    pages = load(spark, d, "pages").select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.col("html").cast("binary").alias("content"), F.lit("page.md").alias("name"))
    scanned = pages.select("host", *files.document_columns(F.col("content"), F.col("name")))
    return scanned.filter(F.col("text").isNotNull() & (F.octet_length("text") == F.col("size_bytes"))).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@query("s9_document_files",
       "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents")
def _(spark, d):
    path = scratch_path(spark, "docs")
    load(spark, d, "documents").select("text").write.text(path, lineSep="\n")
    # Written part files end in .txt, so each is read back as one text document.
    docs = files.read_documents(spark, path, "*.txt")
    return docs.agg(F.sum("size_bytes").alias("bytes"), F.sum(F.length("text")).alias("characters"))


@query("s10_connector_round_trip", rnd(
    "SELECT 'csv' AS format, count(*) AS n, sum(c_acctbal) AS total FROM customer UNION ALL SELECT 'json', count(*), sum(c_acctbal) FROM customer "
    "UNION ALL SELECT 'parquet', count(*), sum(c_acctbal) FROM customer", "total"))
def _(spark, d):
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path, extra = scratch_path(spark, fmt), {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
        files.write_sink(load(spark, d, "customer"), "file", {"format": fmt, "path": path, **({"header": "true"} if extra else {})})
        back = files.read_source(spark, "file", {"format": fmt, "path": path, **extra})
        parts.append(back.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")).select(F.lit(fmt).alias("format"), "n", "total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- streams -----------------------------------------------------------------------

def event_stream(spark, d):
    return W.read_event_stream(spark, d, load(spark, d, "events").schema, pattern="events.parquet")


STAMP = "yyyy-MM-dd HH:mm:ss"


@query("w1_usage_windows",
       f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS uses FROM events GROUP BY 1, 2")
def _(spark, d):
    out = W.run_update(W.usage_windows(event_stream(spark, d), ["event_type"]), "windows", ["window_start", "window_end", "event_type"])
    return out.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "uses")


@query("w1_sliding_windows",
       f"WITH w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s, event_type FROM events, range(3) r(k)) "
       f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS uses FROM w GROUP BY 1, 2")
def _(spark, d):
    out = W.run_update(W.usage_windows(event_stream(spark, d), ["event_type"], length="3 hours", slide="1 hour"), "sliding",
                       ["window_start", "window_end", "event_type"])
    return out.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "uses")


@query("w2_user_sessions",
       "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS st FROM events), "
       "s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), "
       "e AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 8 HOUR AS z, count(*) AS events FROM s GROUP BY user_id, k) "
       f"SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(z, '%Y-%m-%d %H:%M:%S') AS session_end, events FROM e")
def _(spark, d):
    out = W.run_complete(W.user_sessions(event_stream(spark, d), gap="8 hours"), "sessions")
    return out.withColumns({c: F.date_format(c, STAMP) for c in ("session_start", "session_end")})


@query("w3_last_seen",
       "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS events FROM events GROUP BY 1")
def _(spark, d):
    out = W.run_update(W.last_seen(event_stream(spark, d), ["event_type"]), "last-seen", ["event_type"])
    return out.withColumn("last_seen", F.date_format("last_seen", STAMP))


@query("w3_drop_repeats", "SELECT event_id, event_type FROM events")
def _(spark, d):
    twice = event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return W.run_append(W.drop_repeats(twice, ["event_id"]), "repeats").select("event_id", "event_type")
