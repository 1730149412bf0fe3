"""Windows over a whole ordered table, cut into blocks of the row index.

A plain window sends all rows of a partition key to one task. Here rows are
numbered first (see ``with_row_index``) and windows run within blocks of the
index, so one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col

BLOCK_ROWS = 1_000_000


def with_halo(indexed: DataFrame, reach: int, index: str = "row_index", block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and ``_halo``: each block also gets the last ``reach`` rows
    of the block before it, so frames that look back at most ``reach`` rows see
    everything they need. Drop the ``_halo`` rows afterwards."""
    if reach > block:
        raise ValueError("reach must not exceed the block size")
    own = F.floor(col(index) / block).cast("bigint")
    tail = F.pmod(col(index), F.lit(block)) >= block - reach
    copies = F.when(tail, F.array(
        F.struct(own.alias("_block"), F.lit(False).alias("_halo")),
        F.struct((own + 1).alias("_block"), F.lit(True).alias("_halo")),
    )).otherwise(F.array(F.struct(own.alias("_block"), F.lit(False).alias("_halo"))))
    return indexed.select("*", F.inline(copies))


def back_window(keys: Sequence[str] = (), index: str = "row_index"):
    """The window to use on a frame from ``with_halo``, per key within a block."""
    return Window.partitionBy("_block", *keys).orderBy(index)


def running_total(indexed: DataFrame, totals: dict[str, str], keys: Sequence[str] = (),
                  index: str = "row_index", block: int = BLOCK_ROWS) -> DataFrame:
    """Running sums in index order, per key: ``totals`` maps new name to column.

    Sums run within a block; what came before is added from the table of block
    totals, which has one row per block and key.
    """
    cut = indexed.withColumn("_block", F.floor(col(index) / block).cast("bigint"))
    inner = Window.partitionBy("_block", *keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_block", *keys).agg(*[F.sum(col(c)).alias(f"_t_{n}") for n, c in totals.items()])
    starts = sums.select("_block", *keys, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    summed = cut.withColumns({f"_i_{n}": F.sum(col(c)).over(inner) for n, c in totals.items()})
    return summed.join(starts, ["_block", *keys]).select(
        *indexed.columns, *[(F.col(f"_i_{n}") + F.col(f"_s_{n}")).alias(n) for n in totals])
