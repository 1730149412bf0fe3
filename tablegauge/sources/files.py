"""File, document and database readers and writers, and the dataset registry."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names that hold dates although JSON has no date type,
# and the text file types.
DATE_SUFFIXES = ("_at", "_time")
DATE_PREFIXES = ("timestamp",)
DATE_NAMES = ("modified", "date")
TEXT_TYPES = ("txt", "md", "csv", "json", "yaml", "yml")

FILE_FORMATS = ("csv", "json", "parquet", "orc")


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: inferring one reads
    the data an extra time."""
    reader = spark.read.option("header", True)
    return reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)


def is_date_like(name: str) -> bool:
    lowered = name.lower()
    return (lowered.endswith(DATE_SUFFIXES) or lowered.startswith(DATE_PREFIXES) or lowered in DATE_NAMES)


def infer_dates(df: DataFrame) -> DataFrame:
    """Parse text columns with date-like names as timestamps; a column with any
    value that does not parse stays text, as a failed conversion leaves it."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and is_date_like(f.name)]
    if not names:
        return df
    parsed = {c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in names}
    failures = df.agg(*[F.count_if(F.col(c).isNotNull() & parsed[c].isNull()).alias(c) for c in names]).first()
    return df.withColumns({c: parsed[c] for c in names if failures[c] == 0})


def read_json_records(spark: SparkSession, path, schema: str | T.StructType | None = None,
                      multi_line: bool = False) -> DataFrame:
    """JSON records with date-like columns parsed. Use ``multi_line`` for one
    array per file; records per line can be split over tasks."""
    return infer_dates(spark.read.json(path, schema=schema, multiLine=multi_line))


def save_dataset(df: DataFrame, name: str, root: str, created_at: str | None = None) -> DataFrame:
    """Write the table as Parquet under ``root`` and append its registry row.

    The row count is read from the written files' footers, not by running the
    input again.
    """
    spark = df.sparkSession
    path = os.path.join(root, "datasets", name)
    df.write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    entry = stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.sha2(F.lit(name), 256).alias("dataset_id"), F.lit(name).alias("filename"), "rows",
        F.lit(len(df.columns)).alias("columns"), when.alias("created_at"))
    registry = os.path.join(root, "registry")
    entry.write.mode("append").parquet(registry)
    return spark.read.parquet(registry)


def load_dataset(spark: SparkSession, name: str, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, "datasets", name))


def document_columns(content: Column, name: Column) -> list[Column]:
    """Size, digest, extension and whole text of file contents.

    Text files decode as UTF-8, or else as Latin-1; other types have no text.
    """
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.when(extension.isin(*TEXT_TYPES), F.coalesce(utf8, F.decode(content, "ISO-8859-1")))
    return [
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"), extension.alias("extension"), text.alias("text")]


def read_documents(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """Files as rows: path, size, SHA-256 and text."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "modificationTime", *document_columns(F.col("content"), F.col("path")))


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    bounds: tuple | None = None, partitions: int = 16,
                    properties: Mapping[str, str] | None = None) -> DataFrame:
    """A PostgreSQL table through read-only sessions; with a partition column
    the ranges are read in parallel."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("sessionInitStatement", "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY")
              .options(**(properties or {})))
    if partition_column:
        low, high = bounds
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(low))
                  .option("upperBound", str(high)).option("numPartitions", str(partitions)))
    return reader.load()


def read_source(spark: SparkSession, kind: str, options: Mapping) -> DataFrame:
    """Read from a connector: ``file`` and ``s3`` take format and path,
    ``postgres`` takes url and table."""
    if kind in ("file", "s3"):
        if options["format"] not in FILE_FORMATS:
            raise ValueError(f"unknown format: {options['format']}")
        extra = {k: v for k, v in options.items() if k not in ("format", "path")}
        return spark.read.format(options["format"]).options(**extra).load(options["path"])
    if kind == "postgres":
        rest = {k: v for k, v in options.items() if k not in ("url", "table")}
        return read_jdbc_table(spark, options["url"], options["table"], properties=rest)
    raise ValueError(f"unknown connector kind: {kind}")


def write_sink(df: DataFrame, kind: str, options: Mapping, mode: str = "errorifexists",
               partition_by: Sequence[str] = ()) -> None:
    if kind in ("file", "s3"):
        if options["format"] not in FILE_FORMATS:
            raise ValueError(f"unknown format: {options['format']}")
        extra = {k: v for k, v in options.items() if k not in ("format", "path")}
        writer = df.write.mode(mode).format(options["format"]).options(**extra)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(options["path"])
    elif kind == "postgres":
        rest = {k: v for k, v in options.items() if k not in ("url", "table")}
        df.write.jdbc(options["url"], options["table"], mode=mode, properties=rest)
    else:
        raise ValueError(f"unknown connector kind: {kind}")
