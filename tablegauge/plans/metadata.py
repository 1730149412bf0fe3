"""Dictionary, usage, relationship, context, document and conversation queries.

The dictionary tables are made from the supplied ones, so they grow with them:
every part is a documented column, twenty to a table, and every event a usage event.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import context as X
from tablegauge.operators import conversations as V
from tablegauge.operators import dictionary as T
from tablegauge.operators import profile as P
from tablegauge.operators import usage as U
from tablegauge.plans.profiles import SCHEMA_SQL, SCHEMA_TABLES
from tablegauge.plans.registry import ORACLES, each, load, query, rnd, sql_on
from tablegauge.session import literal_table, scratch_path

# --- dictionary entries ---------------------------------------------------

SOURCE = "CASE WHEN p_size % 3 = 0 THEN 'human_edited' ELSE 'llm_initial' END"
# Parts over size 25 have an old inactive version and an active second one.
CURRENT = {
    "spark": f"""SELECT 'default' AS database_name, 'main' AS schema_name, concat('t', p_partkey div 20) AS table_name, concat('p', p_partkey) AS column_name,
      CAST(v AS INT) AS version_number, p_size <= 25 OR v = 2 AS is_active, concat('note ', v) AS version_notes, p_name AS business_name,
      concat('part of ', p_brand) AS business_description, CAST(NULL AS STRING) AS technical_description, 'string' AS data_type,
      array(p_brand) AS examples, split(p_name, ' ') AS tags, {SOURCE} AS source
      FROM (SELECT *, explode(CASE WHEN p_size > 25 THEN array(1, 2) ELSE array(1) END) AS v FROM part)""",
    "duck": f"""SELECT 'default' AS database_name, 'main' AS schema_name, 't' || (p_partkey // 20) AS table_name, 'p' || p_partkey AS column_name,
      CAST(v AS INTEGER) AS version_number, p_size <= 25 OR v = 2 AS is_active, 'note ' || v AS version_notes, p_name AS business_name,
      'part of ' || p_brand AS business_description, CAST(NULL AS VARCHAR) AS technical_description, 'string' AS data_type,
      [p_brand] AS examples, string_split(p_name, ' ') AS tags, {SOURCE} AS source
      FROM (SELECT *, unnest(CASE WHEN p_size > 25 THEN [1, 2] ELSE [1] END) AS v FROM part)""",
}
# Incoming: cheap parts with new texts, and every supplier as a new column.
INCOMING = {
    "spark": """SELECT 'default' AS database_name, 'main' AS schema_name, concat('t', p_partkey div 20) AS table_name, concat('p', p_partkey) AS column_name,
      upper(p_name) AS business_name, 'renewed' AS business_description, 'code' AS technical_description, 'varchar' AS data_type,
      array('x') AS examples, array('category') AS tags, 'llm_initial' AS source FROM part WHERE p_retailprice < 950
      UNION ALL SELECT 'default', 'main', 'supplier', concat('s', s_suppkey), s_name, 'supplier', NULL, 'string', array('y'), array('identifier'), NULL FROM supplier""",
    "duck": """SELECT 'default' AS database_name, 'main' AS schema_name, 't' || (p_partkey // 20) AS table_name, 'p' || p_partkey AS column_name,
      upper(p_name) AS business_name, 'renewed' AS business_description, 'code' AS technical_description, 'varchar' AS data_type,
      ['x'] AS examples, ['category'] AS tags, 'llm_initial' AS source FROM part WHERE p_retailprice < 950
      UNION ALL SELECT 'default', 'main', 'supplier', 's' || s_suppkey, s_name, 'supplier', NULL, 'string', ['y'], ['identifier'], NULL FROM supplier""",
}
FLAT = ("table_name, column_name, version_number, is_active, version_notes, business_name, business_description, "
        "technical_description, data_type, array_to_string(examples, '|') AS examples, array_to_string(tags, '|') AS tags, source")


def flat(df):
    return df.withColumns({"examples": F.array_join("examples", "|"), "tags": F.array_join("tags", "|")}).drop(
        "database_name", "schema_name")


def entries(spark, d):
    return sql_on(spark, d, CURRENT["spark"], "part")


def incoming(spark, d):
    return sql_on(spark, d, INCOMING["spark"], "part", "supplier")


def upsert_sql(force: bool) -> str:
    ver = "true" if force else "c.source = 'human_edited'"
    return (f"WITH c AS ({CURRENT['duck']}), i AS ({INCOMING['duck']}), "
            "m AS (SELECT c.*, i.column_name IS NOT NULL AS hit, i.business_name AS bn, i.business_description AS bd, i.technical_description AS td, "
            "i.data_type AS dt, i.examples AS ex, i.tags AS tg, coalesce(i.source, 'llm_initial') AS sr FROM c LEFT JOIN i "
            "ON c.is_active AND c.table_name = i.table_name AND c.column_name = i.column_name), r AS ("
            f"SELECT table_name, column_name, version_number, CASE WHEN hit AND ({ver.replace('c.', '')}) THEN false ELSE is_active END AS is_active, version_notes, "
            + ", ".join(f"CASE WHEN hit AND NOT ({ver.replace('c.', '')}) THEN {n} ELSE {o} END AS {o}" for o, n in (
                ("business_name", "bn"), ("business_description", "bd"), ("technical_description", "td"), ("data_type", "dt"),
                ("examples", "ex"), ("tags", "tg"), ("source", "sr"))) + " FROM m "
            f"UNION ALL SELECT table_name, column_name, version_number + 1, true, 'Updated by AI analysis', bn, bd, td, dt, ex, tg, sr FROM m WHERE hit AND ({ver.replace('c.', '')}) "
            "UNION ALL SELECT table_name, column_name, 1, true, 'Initial documentation', business_name, business_description, technical_description, data_type, "
            "examples, tags, coalesce(source, 'llm_initial') FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.is_active AND c.table_name = i.table_name "
            f"AND c.column_name = i.column_name)) SELECT {FLAT} FROM r")


@query("t1_upsert_dictionary", upsert_sql(False))
def _(spark, d):
    return flat(T.upsert_dictionary(entries(spark, d), incoming(spark, d)))


@query("t1_upsert_new_versions", upsert_sql(True))
def _(spark, d):
    return flat(T.upsert_dictionary(entries(spark, d), incoming(spark, d), create_new_version=True))


@query("t2_active_entries", f"SELECT {FLAT} FROM ({CURRENT['duck']}) WHERE table_name IN ('t0', 't3', 't4') AND is_active")
def _(spark, d):
    return flat(T.active_entries(entries(spark, d), "default", "main", ["t0", "t3", "t4"]))


@query("t3_version_history",
       f"SELECT {FLAT} FROM ({CURRENT['duck']}) WHERE column_name = (SELECT 'p' || min(p_partkey) FROM part WHERE p_size > 25)")
def _(spark, d):
    first = load(spark, d, "part").filter("p_size > 25").agg(F.concat(F.lit("p"), F.min("p_partkey"))).scalar()
    return flat(T.version_history(entries(spark, d)).filter(F.col("column_name") == first))


@query("t4_activate_versions",
       f"WITH c AS ({CURRENT['duck']}) SELECT table_name, column_name, version_number, CASE WHEN column_name IN "
       "(SELECT 'p' || p_partkey FROM part WHERE p_size > 40) THEN version_number = 1 ELSE is_active END AS is_active FROM c")
def _(spark, d):
    chosen = entries(spark, d).join(
        load(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("column_name")),
        "column_name", "left_semi").filter("version_number = 1")
    return T.activate_versions(entries(spark, d), chosen).select("table_name", "column_name", "version_number", "is_active")


EDITS = {
    "spark": "SELECT 'default' AS database_name, 'main' AS schema_name, concat('t', p_partkey div 20) AS table_name, concat('p', p_partkey) AS column_name, "
             "CASE WHEN p_size % 2 = 0 THEN concat('edited ', p_name) END AS business_name, 'checked' AS business_description FROM part WHERE p_brand = 'Brand#3'",
    "duck": "SELECT 't' || (p_partkey // 20) AS table_name, 'p' || p_partkey AS column_name, "
            "CASE WHEN p_size % 2 = 0 THEN 'edited ' || p_name END AS business_name, 'checked' AS business_description FROM part WHERE p_brand = 'Brand#3'",
}


def edits(spark, d):
    return sql_on(spark, d, EDITS["spark"], "part")


EDIT_CTE = (f"WITH c AS ({CURRENT['duck']}), e AS ({EDITS['duck']}), m AS (SELECT c.*, e.column_name IS NOT NULL AS hit, e.business_name AS bn, "
            "e.business_description AS bd FROM c LEFT JOIN e ON c.is_active AND c.table_name = e.table_name AND c.column_name = e.column_name), ")


@query("t5_edit_new_versions", EDIT_CTE
       + "r AS (SELECT * EXCLUDE (hit, bn, bd) REPLACE (CASE WHEN hit THEN false ELSE is_active END AS is_active) FROM m UNION ALL "
         "SELECT * EXCLUDE (hit, bn, bd) REPLACE (coalesce(bn, business_name) AS business_name, coalesce(bd, business_description) AS business_description, "
         "'human_edited' AS source, version_number + 1 AS version_number, 'Manual edit - new version' AS version_notes) FROM m WHERE hit) "
       + f"SELECT {FLAT} FROM r")
def _(spark, d):
    base = entries(spark, d)
    return flat(T.apply_edits(base, edits(spark, d)))


@query("t5_edit_in_place", EDIT_CTE
       + "r AS (SELECT * EXCLUDE (hit, bn, bd) REPLACE (CASE WHEN hit THEN coalesce(bn, business_name) ELSE business_name END AS business_name, "
         "CASE WHEN hit THEN coalesce(bd, business_description) ELSE business_description END AS business_description, "
         "CASE WHEN hit AND starts_with(source, 'llm') THEN 'human_edited' ELSE source END AS source) FROM m) "
       + f"SELECT {FLAT} FROM r")
def _(spark, d):
    base = entries(spark, d)
    return flat(T.apply_edits(base, edits(spark, d), create_new_version=False))


def stored(spark, d):
    path = scratch_path(spark, "dictionary")
    T.write_dictionary(entries(spark, d), path)
    return path


@query("t1_stored_upsert", upsert_sql(False))
def _(spark, d):
    path = stored(spark, d)
    T.merge_stored(spark, path, incoming(spark, d), expected=1)
    return flat(T.read_dictionary(spark, path))


@query("t5_stored_edits", ORACLES["t5_edit_new_versions"])
def _(spark, d):
    path = stored(spark, d)
    T.edit_stored(spark, path, edits(spark, d), expected=1)
    return flat(T.read_dictionary(spark, path))


@query("t6_context_markdown",
       f"WITH c AS ({CURRENT['duck']}), b AS (SELECT table_name, column_name, '**' || column_name || '** (' || data_type || ')' || "
       "'\n  - ' || business_description || '\n  - Tags: ' || array_to_string(tags, ', ') || '\n' AS t FROM c WHERE is_active) "
       "SELECT 'main' AS schema_name, table_name, '## main.' || table_name || '\n\n' || string_agg(t, '\n' ORDER BY column_name) AS context FROM b GROUP BY table_name")
def _(spark, d):
    return T.context_markdown(entries(spark, d).filter("is_active"))


# Relationships between nation-level tables: every nation links its region and customers.
LINKS = ("SELECT 'main' AS source_schema, 'n' || n_nationkey AS source_table, 'regionkey' AS source_column, 'main' AS target_schema, "
         "'r' || n_regionkey AS target_table, 'regionkey' AS target_column, 'many_to_one' AS cardinality, 'verified' AS confidence FROM nation "
         "UNION ALL SELECT 'main', 'c' || c_custkey, 'nationkey', 'main', 'n' || c_nationkey, 'nationkey', 'many_to_one', 'inferred' FROM customer")


def links(spark, d):
    return sql_on(spark, d, LINKS, "nation", "customer")


@query("t7_relationships_for_tables",
       f"WITH l AS ({LINKS}), e AS (SELECT *, source_table AS table_name, 'outgoing' AS direction FROM l UNION ALL "
       "SELECT *, target_table, 'incoming' FROM l) SELECT table_name, direction, source_table, target_table, cardinality FROM e "
       "WHERE table_name IN (SELECT 'n' || n_nationkey FROM nation)")
def _(spark, d):
    found = links(spark, d)
    tables = load(spark, d, "nation").select(F.lit("main").alias("schema_name"), F.concat(F.lit("n"), "n_nationkey").alias("table_name"))
    return T.relationships_for_tables(found, tables).select("table_name", "direction", "source_table", "target_table", "cardinality")


@query("t8_hash_queries", "SELECT conv_id, turn, sha256(text) AS query_hash FROM conversations")
def _(spark, d):
    return U.hash_queries(load(spark, d, "conversations"), "text").select("conv_id", "turn", "query_hash")


@query("t8_append_usage", "SELECT conv_id, turn, sha256(text) AS query_hash, '2024-01-' || CASE WHEN turn % 2 = 0 THEN '01' ELSE '02' END AS event_date FROM conversations")
def _(spark, d):
    path = scratch_path(spark, "usage-log")
    said = load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query_text"))
    for day, rest in (("2024-01-01", 0), ("2024-01-02", 1)):
        log = U.append_usage(said.filter(F.col("turn") % 2 == rest).withColumn(
            "event_at", F.lit(f"{day} 08:00:00").cast("timestamp_ntz")), path)
    return log.select("conv_id", "turn", "query_hash", F.col("event_date").cast("string").alias("event_date"))


# Usage log: each event used one or two of 20 tables and a column named by its type.
AS_OF = "2024-01-31 00:00:00"
LOG = {
    "spark": "SELECT event_id, ts AS event_at, CASE WHEN user_id % 4 = 0 THEN array(concat('main.t', user_id % 20)) "
             "WHEN user_id % 4 = 1 THEN array(concat('main.t', user_id % 20), concat('main.', event_type)) ELSE array(event_type, concat('main.t', user_id % 20)) END AS tables_used, "
             "array(event_type, concat('c', user_id % 10)) AS columns_used FROM events",
    "duck": "SELECT event_id, ts AS event_at, CASE WHEN user_id % 4 = 0 THEN ['main.t' || (user_id % 20)] "
            "WHEN user_id % 4 = 1 THEN ['main.t' || (user_id % 20), 'main.' || event_type] ELSE [event_type, 'main.t' || (user_id % 20)] END AS tables_used, "
            "[event_type, 'c' || (user_id % 10)] AS columns_used FROM events",
}


def usage_log(spark, d):
    return sql_on(spark, d, LOG["spark"], "events")


USED = f"SELECT unnest(tables_used) AS name, event_at FROM ({LOG['duck']}) WHERE event_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY"


@query("t9_usage_rollup",
       f"WITH a AS (SELECT DISTINCT unnest(tables_used) AS name FROM ({LOG['duck']}) UNION SELECT 'main.unused'), "
       f"u AS (SELECT name, count(*) AS n, max(event_at) AS m FROM ({USED}) WHERE len(string_split(name, '.')) = 2 GROUP BY name) "
       "SELECT a.name AS asset, coalesce(n, 0) AS query_count_30d, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_queried_at FROM a LEFT JOIN u ON a.name = u.name "
       "WHERE len(string_split(a.name, '.')) = 2")
def _(spark, d):
    log = usage_log(spark, d)
    names = log.select(F.explode("tables_used").alias("n")).distinct().union(spark.sql("SELECT 'main.unused'"))
    parts = F.split("n", r"\.")
    assets = names.filter(F.size(parts) == 2).select(
        parts[0].alias("schema_name"), parts[1].alias("table_name"),
        F.lit(0).cast("bigint").alias("query_count_30d"), F.lit(None).cast("timestamp_ntz").alias("last_queried_at"))
    return U.usage_rollup(log, assets, AS_OF, days=10).select(
        F.concat_ws(".", "schema_name", "table_name").alias("asset"), "query_count_30d",
        F.date_format("last_queried_at", "yyyy-MM-dd HH:mm:ss").alias("last_queried_at"))


@query("t10_column_usage",
       f"SELECT c AS column_name, count(*) AS usage_count FROM (SELECT unnest(columns_used) AS c FROM ({LOG['duck']}) "
       f"WHERE event_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) GROUP BY c")
def _(spark, d):
    return U.column_usage(usage_log(spark, d), AS_OF, 10).select("column_name", "usage_count")


@query("t10_join_usage",
       f"WITH l AS (SELECT * FROM ({LOG['duck']}) WHERE event_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY), "
       "r AS (SELECT DISTINCT 'main.t' || (user_id % 20) AS source, 'main.' || event_type AS target FROM events) "
       "SELECT source, target, (SELECT count(*) FROM l WHERE list_contains(tables_used, source) AND list_contains(tables_used, target)) AS join_count_30d FROM r")
def _(spark, d):
    log = usage_log(spark, d)
    pairs = load(spark, d, "events").select(
        F.concat(F.lit("main.t"), F.col("user_id") % 20).alias("source"),
        F.concat(F.lit("main."), "event_type").alias("target")).distinct()
    return U.join_usage(log, pairs, AS_OF, 10)



@query("t11_dictionary_context",
       f"WITH p AS ({SCHEMA_SQL}), a AS (SELECT DISTINCT table_name FROM p), "
       "l AS (SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), "
       "('orders', 'o_custkey', 'customer', 'c_custkey')) v(st, sc, tt, tc)), "
       "e AS (SELECT st AS table_name, 'outgoing:main.' || st || '.' || sc || '>main.' || tt || '.' || tc AS x FROM l UNION ALL "
       "SELECT tt, 'incoming:main.' || st || '.' || sc || '>main.' || tt || '.' || tc FROM l) "
       "SELECT a.table_name, (SELECT string_agg(ordinal_position || ':' || column_name || ':' || data_type || ':' || distinct_count, ',' ORDER BY ordinal_position) "
       "FROM p WHERE p.table_name = a.table_name) AS columns, (SELECT string_agg(x, ',' ORDER BY x) FROM e WHERE e.table_name = a.table_name) AS relationships FROM a")
def _(spark, d):
    tables = {t: load(spark, d, t) for t in SCHEMA_TABLES}
    profiles = P.profile_schema(tables)
    schema = F.lit("main").alias("schema_name")
    assets = profiles.select(schema, "table_name").distinct()
    fields = profiles.select(schema, "table_name", "column_name", "ordinal_position", "data_type",
                             T.friendly_name(F.col("column_name")).alias("business_name"))
    facts = profiles.select(schema, "table_name", "column_name", "null_fraction", "distinct_count")
    relations = literal_table(
        spark, [("main", s, sc, "main", t, tc, "many_to_one", "verified") for s, sc, t, tc in (
            ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
            ("orders", "o_custkey", "customer", "c_custkey"))],
        "source_schema string, source_table string, source_column string, target_schema string, target_table string, "
        "target_column string, cardinality string, confidence string")
    bundle = T.dictionary_context(assets, fields, facts, relations)
    return bundle.select(
        "table_name",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(
            ":", c["ordinal_position"], c["column_name"], c["data_type"], c["distinct_count"])), ",").alias("columns"),
        F.array_join(F.array_sort(F.transform("relationships", lambda r: F.concat(
            r["direction"], F.lit(":"), r["from"], F.lit(">"), r["to"]))), ",").alias("relationships"))


# Suppliers and customers as assets with pseudo facts taken from their columns.
TRUST = """SELECT c_custkey AS asset_id, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE '' END AS business_definition,
  CAST(c_custkey % 60 AS INT) AS days_since_profile, c_acctbal / 40000 AS null_fraction, CAST(c_custkey % 200 AS INT) AS query_count,
  CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_custkey % 45 AS INT) END AS days_since_query, c_mktsegment = 'BUILDING' AS approved,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'late' END AS known_issues FROM customer"""


@query("t12_trust_score",
       f"SELECT asset_id, CAST(greatest(0, least(100, 50 + (CASE WHEN length(business_definition) > 0 THEN 10 ELSE 0 END) + "
       "(CASE WHEN days_since_profile <= 30 THEN 10 ELSE 0 END) + (CASE WHEN null_fraction < 0.05 THEN 10 ELSE 0 END) + "
       "(CASE WHEN query_count >= 100 THEN 10 ELSE 0 END) + (CASE WHEN approved THEN 20 ELSE 0 END) - "
       "(CASE WHEN length(known_issues) > 0 THEN 20 ELSE 0 END) - (CASE WHEN days_since_query IS NULL OR days_since_query > 30 THEN 10 ELSE 0 END) - "
       f"(CASE WHEN null_fraction > 0.2 THEN 10 ELSE 0 END))) AS INTEGER) AS trust_score FROM ({TRUST})")
def _(spark, d):
    return T.trust_score(sql_on(spark, d, TRUST, "customer")).select("asset_id", "trust_score")


@query("t13_retention", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY")
def _(spark, d):
    return U.apply_retention(load(spark, d, "events"), AS_OF, 20, "ts").select("event_id")


KEYS = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey"],
        "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
VALUES = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 3"
                            for t, cols in KEYS.items() for c in cols)


@query("t14_infer_relationships", rnd(
    f"WITH v AS ({VALUES}), k AS (SELECT t, c, count(*) AS d, max(n) AS m FROM v GROUP BY t, c), "
    "p AS (SELECT v.* FROM v JOIN k USING (t, c) WHERE m = 1), "
    "h AS (SELECT v.t, v.c, p.t AS pt, p.c AS pc, count(*) AS hits FROM v JOIN p ON v.v = p.v WHERE v.t <> p.t GROUP BY ALL) "
    "SELECT h.t AS source_table, h.c AS source_column, pt AS target_table, pc AS target_column, hits::DOUBLE / d AS containment, "
    "CASE WHEN m = 1 THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality, 'inferred' AS confidence FROM h JOIN k ON h.t = k.t AND h.c = k.c "
    "WHERE hits::DOUBLE / d >= 0.95", "containment"))
def _(spark, d):
    return T.infer_relationships({t: (load(spark, d, t), cols) for t, cols in KEYS.items()})


TAGGED = [("orders", "o_orderkey", "number"), ("orders", "o_custkey", "number"), ("orders", "o_orderstatus", "text"), ("orders", "o_totalprice", "number"),
          ("orders", "o_orderdate", "moment"), ("orders", "o_orderpriority", "text"), ("documents", "doc_id", "number"), ("documents", "text", "text"),
          ("documents", "lang", "text"), ("documents", "source", "text"), ("documents", "n_chars", "number")]
FACTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS kind, count(DISTINCT {c}) AS d, count(*) AS n, "
    + (f"avg(length({c})) AS len, avg(regexp_matches({c}, '^{T.EMAIL_VALUE}$')::INTEGER) AS mail" if k == "text" else "NULL AS len, NULL AS mail")
    + f" FROM {t}" for t, c, k in TAGGED)


@query("t15_tag_columns",
       f"SELECT table_name, column_name, CASE WHEN kind = 'moment' THEN 'timestamp' WHEN regexp_matches(column_name, '{T.KEY_NAME}') THEN "
       "CASE WHEN d = n THEN 'identifier' ELSE 'foreign_key' END "
       f"WHEN mail > 0.5 OR (kind = 'text' AND regexp_matches(column_name, '{T.PERSON_NAME}')) THEN 'PII' "
       f"WHEN kind = 'number' AND regexp_matches(column_name, '{T.MONEY_NAME}') THEN 'currency' WHEN kind = 'number' THEN 'metric' "
       f"WHEN d <= 50 THEN 'category' WHEN len > 50 THEN 'free_text' ELSE 'other' END AS tag FROM ({FACTS})")
def _(spark, d):
    return T.tag_columns(load(spark, d, "orders"), "orders").unionByName(
        T.tag_columns(load(spark, d, "documents"), "documents"))


# Dictionary fields of the last sync: two tables, one with a human business name.
@query("c3_sync_dictionary",
       f"WITH p AS ({SCHEMA_SQL}), f AS (SELECT table_name, column_name, 'Kept ' || column_name AS bn, 'verified' AS tt FROM p WHERE table_name IN ('orders', 'nation') "
       "UNION ALL SELECT 'legacy', 'old_code', 'Old', 'deprecated') "
       "SELECT coalesce(p.table_name, f.table_name) AS table_name, coalesce(p.column_name, f.column_name) AS column_name, p.ordinal_position, p.data_type, "
       "coalesce(bn, array_to_string(list_transform(string_split(p.column_name, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')) AS business_name, "
       "coalesce(tt, 'experimental') AS trust_tier, CAST(CASE WHEN bn IS NULL THEN 50 ELSE 80 END AS INTEGER) AS trust_score "
       "FROM p FULL OUTER JOIN f ON p.table_name = f.table_name AND p.column_name = f.column_name")
def _(spark, d):
    catalog = P.profile_schema({t: load(spark, d, t) for t in SCHEMA_TABLES}, approx=True).select(
        F.lit("main").alias("schema_name"), "table_name", "column_name", "ordinal_position", "data_type",
        F.col("nullable").alias("is_nullable"))
    known = catalog.filter(F.col("table_name").isin("orders", "nation")).withColumns({
        "business_name": F.concat(F.lit("Kept "), "column_name"), "business_definition": F.lit("by hand"),
        "trust_tier": F.lit("verified"), "trust_score": F.lit(80)})
    legacy = spark.sql("SELECT 'main' AS schema_name, 'legacy' AS table_name, 'old_code' AS column_name, CAST(NULL AS INT) AS ordinal_position, "
                       "CAST(NULL AS STRING) AS data_type, true AS is_nullable, 'Old' AS business_name, 'gone' AS business_definition, "
                       "'deprecated' AS trust_tier, 80 AS trust_score")
    return T.sync_dictionary(known.unionByName(legacy), catalog).select(
        "table_name", "column_name", "ordinal_position", "data_type", "business_name", "trust_tier", "trust_score")


ASSETS = """SELECT 'main' AS schema_name, {cat} AS table_name, p_name AS business_name, p_type AS business_definition,
  CASE WHEN p_size > 25 THEN 'verified' ELSE 'experimental' END AS trust_tier, p_brand AS business_domain FROM part"""


@query("c4_search_assets",
       f"WITH f AS (SELECT * FROM ({ASSETS.format(cat=chr(39) + 'p' + chr(39) + ' || p_partkey')}) WHERE schema_name = 'main' AND "
       "(table_name ILIKE '%BOLT%' OR business_name ILIKE '%BOLT%' OR business_definition ILIKE '%BOLT%') AND trust_tier = 'verified') "
       "SELECT table_name, business_name, trust_tier, (SELECT count(*) FROM f) AS total FROM f ORDER BY schema_name, table_name LIMIT 25 OFFSET 10")
def _(spark, d):
    assets = sql_on(spark, d, ASSETS.format(cat="concat('p', p_partkey)"), "part")
    return T.search_assets(assets, term="BOLT", tier="verified", schema="main", limit=25, offset=10).select(
        "table_name", "business_name", "trust_tier", "total")


# --- documents and contexts -------------------------------------------------

def layer_sql(kind: str, name: str, spec: str, enabled: str) -> str:
    return f"'{{\"enabled\":{enabled},\"kind\":\"{kind}\",\"name\":\"' || {name} || '\",\"spec\":\"{spec}\"}}'"


@query("x1_context_digest",
       "SELECT c_custkey AS context_id, sha256('{\"dataset_ids\":[\"nation-' || c_nationkey || '\",\"orders-' || c_custkey || '\"],\"layers\":[' || "
       + layer_sql("select", "'open'", "o_orderstatus = ''O''", "true") + " || ',' || " + layer_sql("persona", "c_mktsegment", "{}", "false")
       + " || '],\"metadata\":[{\"key\":\"name\",\"value\":\"' || c_name || '\"},{\"key\":\"segment\",\"value\":\"' || c_mktsegment || '\"}]}') AS digest FROM customer")
def _(spark, d):
    # Every customer is a context over its own and its nation's data, with two layers.
    customers = load(spark, d, "customer").withColumnRenamed("c_custkey", "context_id")
    contexts = customers.select(
        "context_id", F.array(F.concat(F.lit("orders-"), "context_id"), F.concat(F.lit("nation-"), "c_nationkey")).alias("dataset_ids"),
        F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("metadata"))

    def layer(position, kind, name, spec, enabled):
        return F.struct(F.lit(position).alias("position"), F.lit(kind).alias("kind"), name.alias("name"),
                        F.lit(spec).alias("spec"), F.lit(enabled).alias("enabled"))

    layers = customers.select("context_id", F.inline(F.array(
        layer(1, "select", F.lit("open"), "o_orderstatus = 'O'", True),
        layer(2, "persona", F.col("c_mktsegment"), "{}", False))))
    return X.context_digest(contexts, layers)


@query("x2_duplicate_documents",
       "WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), g AS (SELECT sha256, min(doc_id) AS keeper_id, count(*) AS copies "
       "FROM h GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, sha256, keeper_id, copies, doc_id <> keeper_id AS is_duplicate FROM h JOIN g USING (sha256)")
def _(spark, d):
    return X.duplicate_documents(load(spark, d, "documents"))


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
PREP = (f"SELECT {{keys}}, CAST(p AS INTEGER) AS part, length(s) AS input_length, md5(s) AS digest FROM (SELECT {{keys}}, p, substring(t, p * 3000 + 1, 3000) AS s "
        f"FROM (SELECT {{keys}}, t, unnest(CASE WHEN length(trim(t, {WS})) >= 50 THEN range((length(t) + 2999) // 3000) ELSE [NULL] END) AS p FROM {{source}}))")


def summary_columns(df):
    return F.length("summary_input").cast("bigint").alias("input_length"), F.md5("summary_input").alias("digest")


@query("x3_summary_inputs", PREP.format(keys="doc_id", source="(SELECT doc_id, text AS t FROM documents)"))
def _(spark, d):
    parts = X.prepare_summary_inputs(load(spark, d, "documents"))
    return parts.select("doc_id", "part", *summary_columns(parts))


@query("x3_combined_inputs",
       "WITH r AS (SELECT *, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) // 5 AS bundle FROM documents), "
       "c AS (SELECT source, lang, bundle, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS t FROM r GROUP BY 1, 2, 3) "
       + PREP.format(keys="source, lang, bundle", source="c"))
def _(spark, d):
    parts = X.combine_documents(load(spark, d, "documents"), ["source", "lang"], "doc_id")
    return parts.select("source", "lang", "bundle", "part", *summary_columns(parts))


@query("x4_apply_layers", rnd(
    "SELECT o_orderkey, o_totalprice, regexp_replace(o_orderpriority, '^[0-9]-', '') AS o_orderpriority, "
    "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, "
    "o_custkey, 'segment ' || c_mktsegment AS o_custkey_definition FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", "o_totalprice"))
def _(spark, d):
    terms = load(spark, d, "customer").select(
        F.col("c_custkey").alias("term"), F.concat(F.lit("segment "), "c_mktsegment").alias("definition"))
    layers = [
        {"step": 3, "kind": "transform", "spec": {"column": "o_orderstatus", "mapping": {"F": "finished", "O": "open"}}},
        {"step": 1, "kind": "select", "spec": {"where": "o_totalprice > 100000"}},
        {"step": 2, "kind": "transform", "spec": {"column": "o_orderpriority", "pattern": "^[0-9]-", "replacement": ""}},
        {"step": 4, "kind": "dictionary", "spec": {"column": "o_custkey", "terms": "customers"}},
        {"step": 5, "kind": "select", "enabled": False, "spec": {"where": "false"}},
    ]
    return X.apply_layers(load(spark, d, "orders").drop("o_orderdate"), layers, {"customers": terms})


def lineage_edges(spark, d):
    def edge(df, a, ka, b, kb):
        return df.select(F.concat(F.lit(a), ka).alias("source"), F.concat(F.lit(b), kb).alias("target"))
    return (edge(load(spark, d, "lineitem"), "part:", "l_partkey", "order:", "l_orderkey")
            .unionByName(edge(load(spark, d, "orders"), "order:", "o_orderkey", "customer:", "o_custkey"))
            .unionByName(edge(load(spark, d, "customer"), "customer:", "c_custkey", "nation:", "c_nationkey")))


@query("x5_lineage_downstream",
       "SELECT 'part:' || p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 1 FROM lineitem "
       "UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 2 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) "
       "UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 3 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def _(spark, d):
    start = load(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node"))
    return X.lineage(lineage_edges(spark, d), start, "downstream")


@query("x5_lineage_upstream",
       "SELECT 'nation:' || n_nationkey AS node, 0 AS depth FROM nation UNION ALL SELECT 'customer:' || c_custkey, 1 FROM customer "
       "UNION ALL SELECT 'order:' || o_orderkey, 2 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    start = load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return X.lineage(lineage_edges(spark, d), start, "upstream", depth=2)


@query("x5_lineage_both",
       "WITH RECURSIVE c(node, top, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, top // 3, steps + 1 FROM c WHERE top > 2) "
       "SELECT 'r' || node AS node, CAST(steps + CASE top WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS depth FROM c WHERE top <= 2 AND (top > 0 OR node = 0) "
       "UNION SELECT 'r0', 1")
def _(spark, d):
    # A tree in which node k hangs on node k // 3, seen from node 1: its parent 0 and through it node 2 and its branch.
    parts = load(spark, d, "part").filter("p_partkey > 0").select("p_partkey")
    edges = parts.select(F.concat(F.lit("r"), "p_partkey").alias("source"), F.concat(F.lit("r"), F.floor(F.col("p_partkey") / 3)).alias("target"))
    return X.lineage(edges, parts.filter("p_partkey = 1").select(F.lit("r1").alias("node")))


@query("x6_latest_values", rnd(
    f"WITH s AS (SELECT user_id AS context_id, event_type AS key, value, ts AS created_at, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 5 DAY END AS expires_at FROM events), "
    f"l AS (SELECT * FROM s WHERE created_at <= TIMESTAMP '{AS_OF}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')) "
    "SELECT context_id, key, max_by(value, (created_at, value)) AS value FROM l GROUP BY 1, 2", "value"))
def _(spark, d):
    store = load(spark, d, "events").select(
        F.col("user_id").alias("context_id"), F.col("event_type").alias("key"), "value", F.col("ts").alias("created_at"),
        F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    return X.latest_values(store, AS_OF).select("context_id", "key", "value")


@query("x7_search_rows",
       "SELECT p_partkey FROM part WHERE contains(lower('\"p_name\":\"' || p_name || '\",\"p_brand\":\"' || p_brand || '\"'), 'ring\",\"p_brand\":\"brand#1')")
def _(spark, d):
    return X.search_rows(load(spark, d, "part"), 'Ring","p_brand":"Brand#1').select("p_partkey")


ANSWER = {
    "spark": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Result:\\n```json\\n{\"a\":', conv_id, '}\\n```\\ndone') "
             "WHEN 1 THEN concat('Sure: [', turn, ',', conv_id, '] ok') WHEN 2 THEN concat('x {\"b\":{\"c\":', turn, '}} y') ELSE text END AS answer FROM conversations",
    "duck": "SELECT conv_id, turn, text FROM conversations",
}


@query("x8_extract_json",
       f"WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, {WS})), lambda s: length(s) > 20) AS k FROM conversations) "
       "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{\"a\":' || conv_id || '}' WHEN 1 THEN '[' || turn || ',' || conv_id || ']' "
       "WHEN 2 THEN '{\"b\":{\"c\":' || turn || '}}' END AS json, CASE WHEN turn % 4 = 3 THEN CAST(len(k) AS INTEGER) END AS insight_count, "
       "CASE WHEN turn % 4 = 3 THEN md5(array_to_string(k, '|')) END AS insights FROM l")
def _(spark, d):
    parsed = X.extract_json(sql_on(spark, d, ANSWER["spark"], "conversations"), "answer")
    return parsed.select("conv_id", "turn", "json",
                         F.when(F.col("key_insights").isNotNull(), F.size("key_insights")).alias("insight_count"),
                         F.md5(F.array_join("key_insights", "|")).alias("insights"))


FINDINGS = """SELECT source AS analysis_id, doc_id AS position, CASE CAST(n_chars % 3 AS INT) WHEN 0 THEN 'issue' WHEN 1 THEN 'anomaly' ELSE 'relationship' END AS kind,
  CASE WHEN n_chars % 5 <> 0 THEN {cat} END AS recommendation FROM documents"""


@query("x9_summarize_findings",
       f"WITH f AS ({FINDINGS.format(cat=chr(39) + 'review ' + chr(39) + ' || lang || (n_chars % 11)')}), "
       "t AS (SELECT analysis_id, recommendation, min(position) AS p FROM f WHERE recommendation IS NOT NULL GROUP BY 1, 2), "
       "c AS (SELECT analysis_id, " + each("count(*) FILTER (WHERE kind = '{c}') AS {c}_count", ["issue", "anomaly", "relationship"], ", ")
       + " FROM f GROUP BY analysis_id) SELECT c.*, recommendation, p AS first_position FROM c LEFT JOIN t USING (analysis_id)")
def _(spark, d):
    findings = sql_on(spark, d, FINDINGS.format(cat="concat('review ', lang, n_chars % 11)"), "documents")
    return X.summarize_findings(findings)


# --- conversations ------------------------------------------------------------

@query("v1_list_conversations",
       "SELECT user_id AS conv_id, (SELECT count(*) FROM conversations WHERE conv_id = user_id) AS message_count, "
       "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY user_id")
def _(spark, d):
    # The last event of a user stands for the time of the conversation with the same number.
    listed = load(spark, d, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.max("ts").alias("updated_at"))
    return V.list_conversations(listed, load(spark, d, "conversations")).select(
        "conv_id", "message_count", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("v2_threads",
       "SELECT conv_id, turn, role, md5(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def _(spark, d):
    return V.threads(load(spark, d, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"), "position")


@query("v3_role_runs",
       "WITH m AS (SELECT conv_id, turn, CASE WHEN turn >= 2 THEN 'tool' ELSE role END AS role FROM conversations), "
       "s AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS st FROM m), "
       "r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s) "
       "SELECT conv_id, role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS messages FROM r GROUP BY conv_id, run, role")
def _(spark, d):
    # Later turns stand for tool messages, which come in runs.
    messages = load(spark, d, "conversations").withColumn(
        "role", F.when(F.col("turn") >= 2, "tool").otherwise(F.col("role")))
    return V.role_runs(messages)


@query("v4_conversation_titles",
       "SELECT conv_id, substring(t, 1, 50) || CASE WHEN length(t) > 50 THEN '...' ELSE '' END AS title FROM "
       "(SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def _(spark, d):
    return V.conversation_titles(load(spark, d, "conversations"))
