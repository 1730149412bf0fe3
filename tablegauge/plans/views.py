"""Derived inputs used by several queries, in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.plans.registry import load

SALES_SQL = """SELECT o_orderdate AS date, p_type AS product_category,
  l_extendedprice AS sales, l_quantity AS quantity, p_retailprice AS price,
  c_mktsegment AS customer_segment, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""

LABELLED_SQL = """SELECT lang, source, n_chars, quality, toxic
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"""

FLAGS_SQL = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem"


def sales(spark: SparkSession, d: str) -> DataFrame:
    """The sales table: one row per order line with its category, segment and region."""
    li, o, p, c, n, r = (load(spark, d, t) for t in
                         ("lineitem", "orders", "part", "customer", "nation", "region"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
        .join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("o_orderdate").alias("date"), F.col("p_type").alias("product_category"),
                F.col("l_extendedprice").alias("sales"), F.col("l_quantity").alias("quantity"),
                F.col("p_retailprice").alias("price"), F.col("c_mktsegment").alias("customer_segment"),
                F.col("r_name").alias("region")))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels; most documents have none, so values are missing."""
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("lang", "source", "n_chars", "quality", "toxic")


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Order lines without their keys, so that whole rows repeat."""
    return load(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
