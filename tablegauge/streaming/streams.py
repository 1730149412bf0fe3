"""Continuous forms of the usage, session and freshness jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col
from tablegauge.session import scratch_path


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, at: str = "ts",
                      pattern: str | None = None) -> DataFrame:
    """Files as a stream. Watermarks need a zoned timestamp, hence the cast."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def usage_windows(events: DataFrame, by: Sequence[str], at: str = "ts", length: str = "1 hour",
                  slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events per tumbling or sliding window and key; later rows are dropped."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, delay).groupBy(window, *by).agg(F.count(F.lit(1)).alias("uses")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "uses")


def user_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes",
                  delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), user).agg(
        F.count(F.lit(1)).alias("events")).select(
        user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def drop_repeats(events: DataFrame, keys: Sequence[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its copies arrive within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def last_seen(events: DataFrame, by: Sequence[str], at: str = "ts") -> DataFrame:
    """Newest event and count per source, for update mode."""
    return events.groupBy(*by).agg(F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("events"))


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run over everything available, append to a table in the shared folder,
    and return that table.

    Windows and sessions that the watermark has not closed are not in it; use
    ``run_update`` or ``run_complete`` to have them too.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", scratch_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class StateTable:
    """The newest row per key of a stream of changes, stored by buckets of the key.

    A batch rewrites the buckets its keys fall into as ``batch=N/bucket=K`` and leaves the others where they are, so what
    is read later is one version of each bucket and not every batch. A batch that is run again reads the versions before
    it and overwrites its own; older versions are deleted when the next batch begins, as the one before is final by then.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, *parts: str) -> list[int]:
        fs, path = self._folder(*parts)
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches that hold each bucket, ascending, of those before the given one."""
        held: dict[int, list[int]] = {}
        for batch in self._numbers("batch", "state"):
            if before is None or batch < before:
                for bucket in self._numbers("bucket", "state", f"batch={batch}"):
                    held.setdefault(bucket, []).append(batch)
        return held

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The current rows (of some buckets); None if nothing is stored."""
        paths = ["/".join([self.path, "state", f"batch={held[-1]}", f"bucket={bucket}"])
                 for bucket, held in self.versions(before).items() if only is None or bucket in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.buckets))

    def merge(self, batch: DataFrame, number: int) -> None:
        for bucket, held in self.versions(number).items():
            for old in held[:-1]:
                fs, path = self._folder("state", f"batch={old}", f"bucket={bucket}")
                fs.delete(path, True)
        changes = "/".join([self.path, "changes"])  # the batch itself, as it is read twice
        batch.withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(changes)
        fresh = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])).parquet(changes)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        old = self.read(number, touched)
        merged = fresh.drop("bucket")
        if old is not None:
            same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in self.keys]
            merged = merged.unionByName(old.alias("o").join(fresh.alias("f"), same, "left_anti"))
        merged.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            "/".join([self.path, "state", f"batch={number}"]))


def run_update(stream: DataFrame, label: str, keys: Sequence[str], buckets: int = 16) -> DataFrame:
    """Run in update mode over everything available and return the newest row per key.

    Every batch is merged into a state table (see ``StateTable``): the result is one row per key as it is, not a roll-up
    of all batches. Use more ``buckets`` for many keys. A column named ``bucket`` is not possible.
    """
    spark = stream.sparkSession
    if "bucket" in {c.lower() for c in stream.columns}:
        raise ValueError("a stream with a column named bucket has no state table")
    table = StateTable(spark, scratch_path(spark, label), stream.schema, keys, buckets)
    query = (stream.writeStream.outputMode("update").foreachBatch(table.merge)
             .option("checkpointLocation", scratch_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    state = table.read()
    return spark.createDataFrame([], stream.schema) if state is None else state


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Run over everything available and return the whole result, open sessions included.

    The state holds every group until the end; use it on a bounded backlog.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (stream.writeStream.outputMode("complete").foreachBatch(save)
             .option("checkpointLocation", scratch_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
