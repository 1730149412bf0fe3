"""Streaming jobs: late rows, repeated rows, sessions, restarts over two files."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.streaming import streams as W

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("user_id", T.LongType())])


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def source(spark, tmp_path, batches):
    """One file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
              .withColumn("ts", F.col("ts").cast("timestamp")))
    return stream


def test_late_rows_are_dropped(spark, tmp_path):
    stream = source(spark, tmp_path, [
        [(1, at(0, 10), 1), (2, at(0, 20), 1), (3, at(5), 2)],
        [(6, at(5, 30), 2)],
        [(4, at(0, 30), 1), (5, at(9), 2)]])  # event 4 comes after its window closed
    out = W.run_append(W.usage_windows(stream, ["user_id"]), "late")
    got = {(r.window_start.hour, r.user_id): r.uses for r in out.collect()}
    assert got == {(0, 1): 2, (5, 2): 2}


def test_sessions_and_repeats(spark, tmp_path):
    stream = source(spark, tmp_path, [
        [(1, at(0), 1), (2, at(0, 20), 1), (2, at(0, 20), 1), (3, at(2), 1)], [(4, at(12), 1)]])
    once = W.run_append(W.drop_repeats(stream, ["event_id"]), "once")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 4]
    sessions = W.run_append(W.user_sessions(stream, gap="30 minutes"), "sessions")
    assert sorted(r.events for r in sessions.collect()) == [1, 3]


def test_last_seen_keeps_the_newest_state(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, at(3), 1), (2, at(1), 2)], [(3, at(2), 1), (4, at(8), 2)]])
    got = {r.user_id: (r.last_seen.hour, r.events) for r in W.run_update(W.last_seen(stream, ["user_id"]), "seen", ["user_id"]).collect()}
    assert got == {1: (3, 2), 2: (8, 2)}


def test_state_table_merges_and_compacts(spark, tmp_path):
    table = W.StateTable(spark, str(tmp_path / "t"), T.StructType.fromDDL("`k.1` string, part int, v int"), ["k.1", "part"], 4)
    make = lambda rows: spark.createDataFrame(rows, table.schema)
    r, want = random.Random(3), {}
    assert table.read() is None
    for number in range(8):
        rows = {(r.choice(["a", "b", "c", None, "hot"]), r.randrange(6)): r.randrange(1000) for _ in range(12)}
        batch = make([(*k, v) for k, v in rows.items()])
        table.merge(batch, number)
        want |= rows
        if number % 3 == 0:
            table.merge(batch, number)  # the same batch again, as after a failure
        got = {(x["k.1"], x.part): x.v for x in table.read().collect()}
        assert got == want and table.read().count() == len(want)
        assert all(len(held) <= 2 for held in table.versions().values())
    table.merge(make([]), 8)
    assert {(x["k.1"], x.part): x.v for x in table.read().collect()} == want


def test_update_runs_over_several_batches(spark, tmp_path):
    schema = T.StructType.fromDDL("ts timestamp, kind string")
    for i in range(4):
        rows = [(at(0) + dt.timedelta(minutes=k), "ab"[k % 2]) for k in range(10 * i, 10 * i + 10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.kind: x.events for x in W.run_update(W.last_seen(source, ["kind"]), "seen", ["kind"], buckets=2).collect()}
    assert got == {"a": 20, "b": 20}
