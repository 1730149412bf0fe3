"""Usage log: digests, roll-ups and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col

USAGE_DAYS = 30


def hash_queries(log: DataFrame, text: str = "query_text") -> DataFrame:
    return log.withColumn("query_hash", F.sha2(col(text), 256))


def append_usage(log: DataFrame, path: str, text: str = "query_text", at: str = "event_at") -> DataFrame:
    """Append usage events with the hash of their query text to the log at ``path``, partitioned by day, and return it."""
    hash_queries(log, text).withColumn("event_date", F.to_date(at)).write.mode("append").partitionBy("event_date").parquet(path)
    return log.sparkSession.read.parquet(path)


def recent(log: DataFrame, as_of: str, days: int = USAGE_DAYS, at: str = "event_at") -> DataFrame:
    """Events of the last ``days`` before ``as_of``; the bound reaches the scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return log.filter(col(at) >= end - F.expr(f"INTERVAL {days} DAYS"))


def usage_rollup(log: DataFrame, assets: DataFrame, as_of: str, days: int = USAGE_DAYS) -> DataFrame:
    """Update each asset's query count and last use from the log.

    Names that are not ``schema.table`` are ignored; assets without use in the
    period keep their counters.
    """
    used = (
        recent(log, as_of, days).select("event_at", F.explode("tables_used").alias("name"))
        .groupBy("name").agg(F.count(F.lit(1)).alias("_uses"), F.max("event_at").alias("_last")))
    parts = F.split("name", r"\.")
    named = used.filter(F.size(parts) == 2).select(
        parts[0].alias("schema_name"), parts[1].alias("table_name"), "_uses", "_last")
    return assets.join(named, ["schema_name", "table_name"], "left").withColumns({
        "query_count_30d": F.coalesce("_uses", "query_count_30d"),
        "last_queried_at": F.coalesce("_last", "last_queried_at")}).select(*assets.columns)


def column_usage(log: DataFrame, as_of: str, days: int = USAGE_DAYS) -> DataFrame:
    return recent(log, as_of, days).select("event_at", F.explode("columns_used").alias("column_name")).groupBy(
        "column_name").agg(F.count(F.lit(1)).alias("usage_count"), F.max("event_at").alias("last_used"))


def join_usage(log: DataFrame, relationships: DataFrame, as_of: str, days: int = USAGE_DAYS) -> DataFrame:
    """How often both tables of a relationship were used in one event.

    Events are first counted per distinct table list, and the list is joined to
    the relationships of its members, so no table pairs are built.
    """
    lists = recent(log, as_of, days).groupBy("tables_used").agg(F.count(F.lit(1)).alias("_n"))
    members = lists.select("tables_used", "_n", F.explode(F.array_distinct("tables_used")).alias("source"))
    hits = members.join(relationships.select("source", "target").distinct(), "source").filter(
        F.array_contains("tables_used", F.col("target")))
    counts = hits.groupBy("source", "target").agg(F.sum("_n").alias("join_count_30d"))
    return relationships.join(counts, ["source", "target"], "left").withColumn(
        "join_count_30d", F.coalesce("join_count_30d", F.lit(0).cast("bigint")))


def apply_retention(log: DataFrame, as_of: str, days: int = 90, at: str = "event_at") -> DataFrame:
    return recent(log, as_of, days, at)
