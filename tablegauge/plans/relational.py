"""SELECT-dialect queries: the texts run through the guarded SQL entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.operators import relational as R
from tablegauge.operators import sql as S
from tablegauge.plans.registry import load, query, rnd, sql_on
from tablegauge.sources import rows


def sql_query(name: str, text: str, tables: str, floats: tuple[str, ...] = (), oracle: str | None = None):
    """Register a SQL text; the oracle is the same text unless the dialects differ."""
    check = oracle or text

    @query(name, rnd(check, *floats) if floats else check)
    def _(spark, d):
        return S.guarded_sql(spark, text, {t: load(spark, d, t) for t in tables.split()})


PAGE_TEXT = ("SELECT l_returnflag, l_linestatus, l_shipdate, count(*) AS n, sum(l_quantity) AS qty FROM lineitem "
             "GROUP BY l_returnflag, l_linestatus, l_shipdate ORDER BY l_shipdate, l_returnflag, l_linestatus")


@query("q1_guarded_sql_page", rnd(
    f"SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, n, qty, "
    f"(SELECT count(*) FROM ({PAGE_TEXT})) AS total_rows FROM ({PAGE_TEXT} LIMIT 100 OFFSET 200)", "qty"))
def _(spark, d):
    page = S.sql_page(spark, PAGE_TEXT, page=3, page_size=100, tables={"lineitem": load(spark, d, "lineitem")},
                      order_by=["l_shipdate", "l_returnflag", "l_linestatus"])
    return page.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


# Query texts made from conversations: each role and length gives another statement.
LOG_TEXT = {
    "spark": "CASE CAST(abs(length(text)) % 7 AS INT) "
             "WHEN 0 THEN concat('SELECT count(*) FROM t', conv_id) "
             "WHEN 1 THEN concat('DELETE FROM t WHERE id = ', turn) "
             "WHEN 2 THEN concat('-- drop\\nSELECT ', turn) "
             "WHEN 3 THEN concat('/* note */ with r AS (SELECT 1) SELECT * FROM r', conv_id) "
             "WHEN 4 THEN concat('SELECT 1; SELECT ', turn) "
             "WHEN 5 THEN concat('SELECT replace(a, ''x'', ''y'') FROM t', turn) "
             "ELSE text END",
}
LOG_TEXT["duck"] = LOG_TEXT["spark"].replace("\\n", "' || chr(10) || '")
BARE = (r"trim(regexp_replace(regexp_replace(upper(trim(q)), '--[^\n]*(\n|$)', '', 'g'), '/\*.*?\*/', '', 'gs'), "
        "' ' || chr(10) || chr(13) || chr(9))")


@query("q2_query_audit",
       f"WITH log AS (SELECT conv_id, turn, {LOG_TEXT['duck']} AS q FROM conversations), b AS (SELECT *, {BARE} AS bare FROM log), "
       "r AS (SELECT conv_id, turn, CASE WHEN NOT (starts_with(bare, 'SELECT') OR starts_with(bare, 'WITH')) "
       f"THEN '{S.ONLY_SELECT}' " + " ".join(
           f"WHEN regexp_matches(upper(q), '\\b{w}\\b') THEN '{S.FORBIDDEN_PREFIX}{w}'" for w in S.FORBIDDEN_WORDS)
       + " WHEN len(list_filter(string_split(q, ';'), lambda s: trim(s, ' ' || chr(10) || chr(13) || chr(9)) <> '')) > 1 "
         f"THEN '{S.ONE_STATEMENT}' END AS reason FROM b) SELECT *, reason IS NULL AS allowed FROM r")
def _(spark, d):
    log = load(spark, d, "conversations").withColumn("q", F.expr(LOG_TEXT["spark"]))
    return S.audit_queries(log, "q").select("conv_id", "turn", "reason", "allowed")


sql_query("q3_projection",
          "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, l_extendedprice * (1 - l_discount) AS net, "
          "CASE WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS size_band, "
          "CAST(l_partkey AS VARCHAR(20)) AS part_text FROM lineitem", "lineitem", ("net",),
          )
sql_query("q4_filter",
          "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 "
          "AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus LIKE 'O%' AND o_orderpriority ILIKE '%u%' "
          "AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '1000' DAY AND o_custkey IS NOT NULL",
          "orders", ("o_totalprice",))
sql_query("q5_inner_join",
          "SELECT n_name, o_orderpriority, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders "
          "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority",
          "orders customer nation", ("total",))
sql_query("q6_outer_joins",
          "SELECT 'left' AS kind, count(*) AS n_rows, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey "
          "UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey "
          "UNION ALL SELECT 'full', count(*), count(l_linenumber) FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey",
          "customer orders lineitem")
sql_query("q7_semi_anti_join",
          "SELECT 'semi' AS kind, count(*) AS n, sum(c_acctbal) AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') "
          "UNION ALL SELECT 'anti', count(*), sum(c_acctbal) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') "
          "UNION ALL SELECT 'in', count(*), sum(c_acctbal) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
          "customer orders", ("balance",))


BANDS = "SELECT b AS band, b * 25000.0 AS low, (b + 1) * 25000.0 AS high FROM range(40) t(b)"


@query("q8_range_join", rnd(
    f"SELECT band, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders JOIN ({BANDS}) ON o_totalprice >= low AND o_totalprice < high GROUP BY band",
    "mean_price"))
def _(spark, d):
    bands = spark.range(40).select(F.col("id").alias("band"), (F.col("id") * 25000.0).alias("low"),
                                   ((F.col("id") + 1) * 25000.0).alias("high"))
    joined = R.range_join(load(spark, d, "orders"), bands, "o_totalprice", "low", "high", 25000.0)
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))


# Ranges above each supplier's balance, from half a unit to beyond all balances; the smallest cell is 10.
NESTED = ("SELECT s_suppkey AS range_id, s_acctbal AS low, s_acctbal + CASE s_suppkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 40.0 WHEN 2 THEN 3000.0 "
          "ELSE 1000000.0 END AS high FROM supplier")


@query("q8_range_join_any_length",
       f"SELECT range_id, count(*) AS n FROM customer JOIN ({NESTED}) ON c_acctbal >= low AND c_acctbal < high GROUP BY range_id")
def _(spark, d):
    # Some ranges hold nearly all customers, so the pairs grow as the product of both tables: they are counted, not listed.
    met = R.range_join(load(spark, d, "customer"), sql_on(spark, d, NESTED, "supplier"), "c_acctbal", "low", "high", 10.0, count="pairs")
    return met.groupBy("range_id").agg(F.sum("pairs").alias("n"))


@query("q8_interval_join",
       "WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup') "
       "SELECT s.event_id AS signup_id, count(*) AS orders_within FROM s JOIN events e "
       "ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 DAY GROUP BY s.event_id")
def _(spark, d):
    # Joined on the user and the day, so that a busy user's events only meet the signups of that day and the one before.
    day = F.expr("INTERVAL 1 DAY")
    events = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts", F.date_trunc("day", "ts").alias("day"))
    signups = events.filter("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("start"),
        F.explode(F.array(F.col("day"), F.col("day") + day)).alias("day"))
    return (events.join(signups, ["user_id", "day"])
            .filter((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.expr("INTERVAL 1 DAY")))
            .groupBy("signup_id").agg(F.count(F.lit(1)).alias("orders_within")))


@query("q9_group_maximum", rnd(
    "SELECT o_custkey, max(o_totalprice) AS o_totalprice, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "o_totalprice"))
def _(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", "o_orderkey")).alias("b")
    return load(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.*")


sql_query("q10_dimension_join",
          "SELECT p_brand, s_nationkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem "
          "JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_nationkey",
          "lineitem part supplier", ("revenue",))
sql_query("q11_aggregation",
          "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, "
          "CAST(CAST(min(l_shipdate) AS DATE) AS STRING) AS first_day, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
          "lineitem", ("sum_qty", "avg_price", "min_disc", "max_tax"))
sql_query("q12_count_distinct",
          "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
          "events")
sql_query("q13_having",
          "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n, avg(o_totalprice) AS mean_price "
          "FROM orders GROUP BY y, m HAVING count(*) > 100", "orders", ("mean_price",))
sql_query("q14_grouping_sets",
          "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem "
          "GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "lineitem", ("qty",))
sql_query("q14_cube_rollup",
          "SELECT 'cube' AS kind, o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) "
          "UNION ALL SELECT 'rollup', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
          "orders")
sql_query("q15_ranking_windows",
          "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS drk, ntile(4) OVER w AS quarter, "
          "percent_rank() OVER w AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), "
          "p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", "orders", ("pr",),
          oracle="SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER p AS INTEGER) AS rk, CAST(dense_rank() OVER p AS INTEGER) AS drk, "
                 "CAST(ntile(4) OVER w AS INTEGER) AS quarter, percent_rank() OVER w AS pr FROM orders "
                 "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
sql_query("q16_analytic_windows",
          "SELECT event_id, lag(value) OVER w AS previous, lead(value) OVER w AS following, first_value(value) OVER w AS first_v, "
          "last_value(value) OVER a AS last_v, sum(value) OVER r AS running, avg(value) OVER s AS sliding FROM events "
          "WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id), "
          "a AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), "
          "r AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
          "s AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "events",
          ("previous", "following", "first_v", "last_v", "running", "sliding"))
sql_query("q17_top_k",
          "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "orders", ("o_totalprice",))
sql_query("q17_most_active_users",
          "SELECT user_id, count(*) AS action_count FROM events GROUP BY user_id ORDER BY action_count DESC, user_id LIMIT 10", "events")
sql_query("q18_set_operations",
          "SELECT 'union' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part) u "
          "UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part) i "
          "UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) e "
          "UNION ALL SELECT 'except all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer) a "
          "UNION ALL SELECT 'intersect all', count(*) FROM (SELECT o_custkey FROM orders INTERSECT ALL SELECT c_custkey FROM customer) b",
          "lineitem part orders customer")
sql_query("q19_cte",
          "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), "
          "ranked AS (SELECT c_mktsegment, total FROM spend JOIN customer ON o_custkey = c_custkey) "
          "SELECT c_mktsegment, count(*) AS customers, avg(total) AS mean_spend FROM ranked GROUP BY c_mktsegment", "orders customer", ("mean_spend",))
sql_query("q19_recursive_cte",
          "WITH RECURSIVE months(m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM months WHERE m < 12), "
          "n AS (SELECT month(o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1) "
          "SELECT m, n FROM months LEFT JOIN n ON m = mo", "orders")
sql_query("q20_correlated_subqueries",
          "SELECT o_orderkey, o_totalprice, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS max_qty FROM orders o "
          "WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)",
          "orders lineitem", ("o_totalprice", "max_qty"))
sql_query("q21_unnest",
          "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) w GROUP BY word", "part",
          oracle="SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) w GROUP BY word")
sql_query("q22_revenue_by_month",
          "SELECT date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS month, sum(o_totalprice) AS total_revenue, count(*) AS order_count "
          "FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '365' DAY GROUP BY 1 ORDER BY 1 DESC", "orders", ("total_revenue",),
          oracle="SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, sum(o_totalprice) AS total_revenue, count(*) AS order_count "
                 "FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '365' DAY GROUP BY 1")
sql_query("q23_scalar_functions",
          "SELECT event_id, upper(event_type) AS u, concat(event_type, '-', CAST(user_id AS STRING)) AS k, length(props) AS len, "
          "CAST(get_json_object(props, '$.k') AS INT) AS json_k, round(sqrt(value), 4) AS root, abs(CAST(user_id AS INT) - 75) AS dist, "
          "substring(event_type, 1, 3) AS head, element_at(split(event_type, 'i'), 1) AS first_part, size(split(event_type, 'i')) AS parts, "
          "element_at(map(event_type, user_id), event_type) AS mapped FROM events", "events", ("root",),
          oracle="SELECT event_id, upper(event_type) AS u, event_type || '-' || user_id AS k, CAST(length(props) AS INTEGER) AS len, "
                 "CAST(json_extract_string(props, '$.k') AS INTEGER) AS json_k, round(sqrt(value), 4) AS root, CAST(abs(user_id - 75) AS INTEGER) AS dist, "
                 "substring(event_type, 1, 3) AS head, string_split(event_type, 'i')[1] AS first_part, CAST(len(string_split(event_type, 'i')) AS INTEGER) AS parts, "
                 "user_id AS mapped FROM events")

STEPS = [
    {"kind": "filter", "condition": "o_orderstatus <> 'P'"},
    {"kind": "join", "table": "customer", "on": ["o_custkey"]},
    {"kind": "map", "columns": {"year": "year(o_orderdate)", "high": "o_totalprice > 250000"}},
    {"kind": "aggregate", "by": ["c_mktsegment", "year", "high"],
     "measures": {"n": "count(*)", "total": "sum(o_totalprice)"}},
    {"kind": "filter", "condition": "n > 1"},
]


@query("q24_transform_steps", rnd(
    "SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice > 250000 AS high, count(*) AS n, sum(o_totalprice) AS total "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL HAVING count(*) > 1", "total"))
def _(spark, d):
    customer = load(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return R.run_pipeline(load(spark, d, "orders"), STEPS, {"customer": customer})


@query("s6_page_rows", rnd(
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 400", "o_totalprice"))
def _(spark, d):
    return rows.page_rows(load(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 3, 200).select("o_orderkey", "o_totalprice")


@query("s7_sample_rows", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 30 OFFSET 100")
def _(spark, d):
    return rows.sample_rows(load(spark, d, "events"), ["ts", "event_id"], 30, 100).select("event_id", "user_id")


@query("s8_sample_for_profile", "SELECT l_returnflag, count(*) AS n, true AS share_near_half FROM lineitem GROUP BY 1")
def _(spark, d):
    # Six standard deviations of a Bernoulli sample's size around one half.
    li = load(spark, d, "lineitem")
    taken = rows.sample_for_profile(li, 0.5, seed=7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k"))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(taken, "l_returnflag", "left").select(
        "l_returnflag", "n", (F.abs(F.col("k") - F.col("n") / 2) <= 3 * F.sqrt("n")).alias("share_near_half"))


