"""What the corpus operators share: stored intermediate tables, Arrow batches in bounded pieces, joins with hot keys.

The caller's columns travel in one struct column named ``row``, so that names an operator adds never clash with
names the input already has.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.session import scratch_path

SLICE_BYTES = 4 << 20  # text that one step of a Python worker holds at a time; a longer text is a slice of its own
HOT_SHARE = 1000  # a key is hot with more than this fraction of the rows, so there are at most this many hot keys
HOT_LEAST = 100


PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_workers(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers where this package is, in case it is not installed."""
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), PACKAGE_HOME])
    return df


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(names: Sequence[str]) -> Column:
    return F.struct(*[col(n) for n in names]).alias("row")


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, carry: Sequence[str], schema: str,
              make: Callable[[], Callable[[list], list]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``row`` with the carried columns, and the columns of ``schema`` that a function gives for each list of texts.

    ``make`` runs once per task and returns the function; that maps a list of texts (None for null) to one list or
    Arrow array per column of ``schema``.
    """
    source = df.select(as_row(carry), col(text).cast("string").alias("text"))
    out = T.StructType([source.schema["row"], *T.StructType.fromDDL(schema).fields])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[x if isinstance(x, pa.Array) else pa.array(x) for x in fn(part.column(1).to_pylist())]],
                    names=names)

    return with_workers(source).mapInArrow(run, out)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with their group (one row per key; ``size`` is its number of rows among ``total``).

    Groups that hold more than a thousandth of the rows are at most a thousand and are broadcast; the others are
    joined by a shuffle in which no key is large.
    """
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
