"""Catalog and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.operators import states as S
from tablegauge.plans.registry import each, load, query, rnd
from tablegauge.plans.views import LABELLED_SQL, labelled
from tablegauge.session import scratch_path

LINEITEM = [
    ("l_orderkey", "bigint", 1), ("l_partkey", "bigint", 1), ("l_suppkey", "bigint", 1),
    ("l_linenumber", "int", 1), ("l_quantity", "double", 1), ("l_extendedprice", "double", 1),
    ("l_discount", "double", 1), ("l_tax", "double", 1), ("l_returnflag", "string", 0),
    ("l_linestatus", "string", 0), ("l_shipdate", "timestamp_ntz", 0)]
LABELLED = [("lang", "string", 0), ("source", "string", 0), ("n_chars", "bigint", 1),
            ("quality", "int", 1), ("toxic", "int", 1)]


def profile_sql(columns, source: str, extra: str = "") -> str:
    parts = []
    for i, (c, kind, numeric) in enumerate(columns):
        stats = (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                 f"avg(CAST({c} AS DOUBLE)) AS avg") if numeric else (
            "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg")
        parts.append(
            f"SELECT CAST({i + 1} AS INTEGER) AS ordinal_position, '{c}' AS column_name, "
            f"'{kind}' AS data_type, true AS nullable, count(*) AS total_rows, "
            f"count(*) - count({c}) AS null_count, "
            f"CASE WHEN count(*) > 0 THEN (count(*) - count({c}))::DOUBLE / count(*) ELSE 0 END AS null_fraction, "
            f"count(DISTINCT {c}) AS distinct_count, {stats}{extra} FROM {source}")
    return " UNION ALL ".join(parts)


LINEITEM_PROFILE = rnd(profile_sql(LINEITEM, "lineitem"), "null_fraction", "min", "max", "avg")


@query("p2_profile_table", LINEITEM_PROFILE)
def profile_lineitem(spark, d):
    return P.profile_table(load(spark, d, "lineitem"))


@query("p2_profile_table_with_nulls",
       rnd(profile_sql(LABELLED, f"({LABELLED_SQL})"), "null_fraction", "min", "max", "avg"))
def _(spark, d):
    return P.profile_table(labelled(spark, d))


@query("p1_table_summary", rnd(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS data_type, (SELECT count(DISTINCT {c}) FROM orders) AS distinct_count, "
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS avg, "
           f"count({c}) AS value_count" if num else
           "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg, "
           "CAST(NULL AS BIGINT) AS value_count") + (" FROM orders" if num else "")
        for c, k, num in [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1),
                          ("o_orderstatus", "string", 0), ("o_totalprice", "double", 1),
                          ("o_orderdate", "timestamp_ntz", 0), ("o_orderpriority", "string", 0)]),
    "min", "max", "avg"))
def _(spark, d):
    return P.table_summary(load(spark, d, "orders"))


@query("p3_numeric_profile", rnd(each(
    "SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    "avg({c}) AS avg FROM lineitem WHERE {c} IS NOT NULL", [c for c, _, n in LINEITEM if n]),
    "min", "max", "avg"))
def _(spark, d):
    return P.profile_table(load(spark, d, "lineitem"), approx=True).filter(
        F.col("avg").isNotNull()).select("column_name", "min", "max", "avg")


@query("p4_top_values",
       "WITH v AS (" + each("SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part "
                            "WHERE {c} IS NOT NULL GROUP BY 2", ["p_name", "p_brand", "p_type"])
       + "), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position, "
         "count(*) OVER (PARTITION BY column_name) AS k FROM v) "
         "SELECT column_name, CAST(position AS INTEGER) AS position, value, n AS count, k AS distinct_count FROM r "
         "WHERE position <= 50")
def _(spark, d):
    return P.top_values(load(spark, d, "part"), 50)


@query("p5_extended_profile", rnd(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, "
    f"count(DISTINCT {c})::DOUBLE / count(*) AS uniqueness_fraction, "
    + (f"stddev_samp({c}) AS stddev, quantile_cont({c}, 0.5)::DOUBLE AS median, " if n else
       "CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS median, ")
    + f"(SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}))::DOUBLE "
      "/ count(*) AS top_fraction FROM lineitem" for c, _, n in LINEITEM),
    "uniqueness_fraction", "stddev", "median", "top_fraction", digits=6), digits=6)
def _(spark, d):
    return P.profile_columns(load(spark, d, "lineitem"))


@query("p6_string_profile", rnd(each(
    "SELECT '{c}' AS column_name, CAST(min(length({c})) AS BIGINT) AS min_length, "
    "CAST(max(length({c})) AS BIGINT) AS max_length, avg(length({c})) AS avg_length FROM documents",
    ["text", "lang", "source"]), "avg_length"))
def _(spark, d):
    return P.string_profile(load(spark, d, "documents"))


@query("p7_temporal_profile",
       "SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, "
       "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events")
def _(spark, d):
    return P.temporal_profile(load(spark, d, "events"))


@query("p8_append_profile", rnd(
    "SELECT column_name, table_name, total_rows, null_count, distinct_count, avg, "
    "CAST(sample_size AS BIGINT) AS sample_size, sample_method, CAST(version AS INTEGER) AS version FROM ("
    + profile_sql(LINEITEM, "lineitem", ", 'lineitem' AS table_name, count(*) AS sample_size, "
                                        "'full' AS sample_method, 1 AS version")
    + " UNION ALL " + profile_sql(LINEITEM, "(SELECT * FROM lineitem WHERE l_returnflag = 'R')",
                                  ", 'lineitem' AS table_name, count(*) AS sample_size, "
                                  "'full' AS sample_method, 2 AS version") + ")", "avg"))
def _(spark, d):
    # Two snapshots: the whole table, then the returned lines only.
    li, path = load(spark, d, "lineitem"), scratch_path(spark, "profiles")
    P.append_profile(li, "lineitem", path, "2024-01-01 00:00:00", version=1)
    snapshots = P.append_profile(li.filter("l_returnflag = 'R'"), "lineitem", path,
                                 "2024-01-02 00:00:00", version=2)
    return snapshots.select("column_name", "table_name", "total_rows", "null_count", "distinct_count",
                            "avg", "sample_size", "sample_method", "version")


# Monthly profiles of orders stand for a snapshot history.
MONTHLY = ("SELECT strftime(o_orderdate, '%Y-%m') AS computed_at, 'orders' AS table_name, "
           "'{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
           "(count(*) - count({c}))::DOUBLE / count(*) AS null_fraction, avg({c}) AS avg "
           "FROM orders GROUP BY 1")
MONTHLY_SQL = each(MONTHLY, ["o_totalprice", "o_custkey"])


def monthly_profiles(spark, d):
    orders = load(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("computed_at"),
        F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double"))
    long = orders.unpivot(["computed_at"], ["o_totalprice", "o_custkey"], "column_name", "value")
    n = F.count(F.lit(1))
    return long.groupBy("computed_at", "column_name").agg(
        n.alias("row_count"), F.countDistinct("value").alias("distinct_count"),
        ((n - F.count("value")) / n).alias("null_fraction"), F.avg("value").alias("avg")).select(
        "computed_at", F.lit("orders").alias("table_name"), "column_name", "row_count",
        "distinct_count", "null_fraction", "avg")


@query("p9_latest_profiles", rnd(
    f"SELECT * FROM ({MONTHLY_SQL}) WHERE computed_at = (SELECT max(computed_at) FROM ({MONTHLY_SQL}))",
    "null_fraction", "avg"))
def _(spark, d):
    return P.latest_profiles(monthly_profiles(spark, d))


@query("p9_profile_history", rnd(
    f"SELECT * FROM ({MONTHLY_SQL}) WHERE column_name = 'o_totalprice'", "null_fraction", "avg"))
def _(spark, d):
    return P.profile_history(monthly_profiles(spark, d), "orders", "o_totalprice")


@query("p10_profile_drift", rnd(
    f"WITH m AS ({MONTHLY_SQL}) SELECT column_name, computed_at, null_fraction, distinct_count, avg, "
    + ", ".join(f"{m} - lag({m}) OVER (PARTITION BY column_name ORDER BY computed_at) AS {m}_change"
                for m in ("null_fraction", "distinct_count", "avg")) + " FROM m",
    "null_fraction", "avg", "null_fraction_change", "avg_change"))
def _(spark, d):
    return P.profile_drift(monthly_profiles(spark, d))


# States of the orders by year, merged: exact parts equal those of the whole table, sketches stay in their bounds.
STATE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
STATE_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def order_states(spark, d):
    orders, path = load(spark, d, "orders").select("o_orderdate", *STATE_COLUMNS), scratch_path(spark, "states")
    early = orders.filter("year(o_orderdate) < 1998").select(*STATE_COLUMNS, "o_orderdate")
    year = F.date_format("o_orderdate", "yyyy")
    S.append_states(early, path, year)
    return S.append_states(orders.select(*STATE_COLUMNS, "o_orderdate"), path, year).filter(F.col("column_name").isin(STATE_COLUMNS))


@query("p8_merged_states", rnd(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
        + (f"avg({c})::DOUBLE AS avg, stddev_samp({c}::DOUBLE) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
           if c in STATE_NUMBERS else "CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, ")
        + (f"CAST(NULL AS INTEGER) AS max_length, CAST(NULL AS DOUBLE) AS avg_length, " if c in STATE_NUMBERS
           else f"CAST(max(len({c})) AS INTEGER) AS max_length, avg(len({c}))::DOUBLE AS avg_length, ")
        + "true AS distinct_within_bound, true AS quantiles_within_bound FROM orders" for c in STATE_COLUMNS),
    "avg", "std", "min", "max", "avg_length"))
def _(spark, d):
    orders = load(spark, d, "orders")
    merged = S.profile_of_states(S.merge_states(order_states(spark, d)))
    exact = P.profile_table(orders).select("column_name", F.col("distinct_count").alias("exact"))
    # The share of values below a sketched quartile, counted over all rows.
    quartiles = merged.filter(F.col("column_name").isin(STATE_NUMBERS)).select("column_name", "q25", "median", "q75")
    long = orders.select(*[F.col(c).cast("double") for c in STATE_NUMBERS]).unpivot([], STATE_NUMBERS, "column_name", "value")
    shares = long.join(F.broadcast(quartiles), "column_name").groupBy("column_name").agg(*[
        F.avg((F.col("value") <= F.col(q)).cast("double")).alias(q) for q in ("q25", "median", "q75")])
    near = shares.select("column_name", *[(F.abs(F.col(q) - p) <= S.RANK_ERROR).alias(q) for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    return merged.drop("q25", "median", "q75").join(exact, "column_name").join(near, "column_name", "left").select(
        "column_name", "total_rows", "null_count", "avg", "std", "min", "max", "max_length", "avg_length",
        (F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), S.DISTINCT_ERROR * F.col("exact"))).alias("distinct_within_bound"),
        F.coalesce(F.col("q25") & F.col("median") & F.col("q75"), F.lit(True)).alias("quantiles_within_bound"))


@query("p10_state_drift", rnd(
    "WITH s AS (" + " UNION ALL ".join(
        f"SELECT strftime(o_orderdate, '%Y') AS partition, '{c}' AS column_name, (count(*) - count({c}))::DOUBLE / count(*) AS null_fraction, "
        f"{f'avg({c})::DOUBLE' if c in STATE_NUMBERS else 'CAST(NULL AS DOUBLE)'} AS avg FROM orders GROUP BY 1" for c in STATE_COLUMNS)
    + ") SELECT *, null_fraction - lag(null_fraction) OVER w AS null_fraction_change, avg - lag(avg) OVER w AS avg_change FROM s WINDOW w AS (PARTITION BY column_name ORDER BY partition)",
    "null_fraction", "avg", "null_fraction_change", "avg_change"))
def _(spark, d):
    return S.state_drift(order_states(spark, d)).select(
        "partition", "column_name", "null_fraction", "avg", "null_fraction_change", "avg_change")


SCHEMA_TABLES = {
    "region": [("r_regionkey", "int", 1), ("r_name", "string", 0)],
    "nation": [("n_nationkey", "int", 1), ("n_name", "string", 0), ("n_regionkey", "int", 1)],
    "customer": [("c_custkey", "bigint", 1), ("c_name", "string", 0), ("c_nationkey", "int", 1),
                 ("c_acctbal", "double", 1), ("c_mktsegment", "string", 0)],
    "orders": [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0),
               ("o_totalprice", "double", 1), ("o_orderdate", "timestamp_ntz", 0),
               ("o_orderpriority", "string", 0)],
}
SCHEMA_SQL = " UNION ALL ".join(
    profile_sql(cols, t, f", '{t}' AS table_name") for t, cols in SCHEMA_TABLES.items())


@query("p11_profile_schema", rnd(SCHEMA_SQL, "null_fraction", "min", "max", "avg"))
def _(spark, d):
    return P.profile_schema({t: load(spark, d, t) for t in SCHEMA_TABLES})


@query("p12_schema_summary",
       "WITH p AS (" + SCHEMA_SQL + "), l AS (SELECT table_name, ordinal_position, total_rows, "
       "'  • ' || column_name || ' (' || data_type || ')' || "
       "CASE WHEN null_fraction > 0 THEN printf(' - %.1f%% null', null_fraction * 100) ELSE '' END || "
       "CASE WHEN min IS NOT NULL THEN ' - Range: [' || CAST(min AS VARCHAR) || ', ' || CAST(max AS VARCHAR) || ']' ELSE '' END || "
       "CASE WHEN avg IS NOT NULL THEN printf(' - Avg: %.2f', avg) ELSE '' END || "
       "CASE WHEN distinct_count > 0 THEN ' - Distinct: ' || format('{:,}', distinct_count) ELSE '' END AS line FROM p) "
       "SELECT table_name, '**Table: main.' || table_name || '**\n- Total Rows: ' || format('{:,}', max(total_rows)) "
       "|| '\n- Column Count: ' || count(*) || '\n\nColumns:\n' || "
       "string_agg(line, '\n' ORDER BY ordinal_position) || '\n' AS summary FROM l GROUP BY table_name")
def _(spark, d):
    return P.schema_summary(P.profile_schema({t: load(spark, d, t) for t in SCHEMA_TABLES}), "main")


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@query("c1_table_inventory",
       "SELECT *, count(*) OVER (PARTITION BY schema_name) AS tables_in_schema FROM ("
       + " UNION ALL ".join(
           f"SELECT '{'texts' if t in ('documents', 'pages', 'benchmark', 'labels', 'conversations') else 'main'}' "
           f"AS schema_name, '{t}' AS table_name, 'table' AS kind, count(*) AS row_count FROM {t}"
           for t in TABLES)
       + " UNION ALL SELECT 'main', 'sales', 'view', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def _(spark, d):
    texts = {"documents", "pages", "benchmark", "labels", "conversations"}
    tables = {t: ("texts" if t in texts else "main", "table", load(spark, d, t)) for t in TABLES}
    view = load(spark, d, "lineitem").join(
        load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    tables["sales"] = ("main", "view", view)
    return P.table_inventory(tables)


@query("c2_column_inventory",
       f"SELECT table_name, column_name, ordinal_position, data_type, null_count, distinct_count FROM ({SCHEMA_SQL})")
def _(spark, d):
    return P.column_inventory({t: load(spark, d, t) for t in SCHEMA_TABLES})
