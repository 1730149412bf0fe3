"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_local_scratch: str | None = None
_made: list[str] = []


def build_session(app: str = "tablegauge", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator assumes.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    leave both out and let the submit command and AQE decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Sessions are merged per task before the shuffle, so a busy user sends few rows.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def with_workers(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers where this package is, in case it is not installed."""
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), PACKAGE_HOME])
    return df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder: on a cluster the executors
    would each see a different one, so a missing setting is an error there.
    """
    global _local_scratch
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tablegauge-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it belongs to the innermost open ``scratch`` block, if any."""
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables this process has made, from the ``since``-th on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_made) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of the intermediate tables made inside the block: they are deleted when it ends.

    Results that read them must be written or collected before that.
    """
    since = len(_made)
    try:
        yield
    finally:
        drop_scratch(spark, since)


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of constants. Unlike a table made from local rows its size is
    known to the optimizer, so a join with it is broadcast from the start."""
    fields = StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like a checkpoint, survives lost executors, and keeps column
    pruning because the copy is Parquet. Worth it before a report that reads a
    joined input several times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
