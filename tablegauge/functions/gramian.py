"""Correlations of all column pairs from one scan.

Every task adds up the cross products of its rows for all pairs at once, each pair over the rows that hold both values,
and sends one row of matrices. These are merged pairwise in two steps, so no task meets more than about the square root
of their number. Matrices are kept as counts, means and centred moments, which merge without losing digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col
from tablegauge.session import with_workers

CHUNK_CELLS = 1 << 20  # cells of the table that are multiplied at a time
ROUNDING = 1e-13  # a spread under this share of the squared distance from the first value is rounding
MERGE_ROUNDING = 1e-28  # the same for means of equal values that differ in their last bit
PARTS = ("n", "mean_x", "mean_y", "xx", "yy", "xy")
Moments = tuple[np.ndarray, ...]


def moments(values: np.ndarray) -> Moments:
    """For every column pair (i, j) over rows with both values: their number, the means of i and of j, and the centred
    sums of squares of i, of j, and of their products. ``values`` has a row per row and NaN for missing values."""
    present = ~np.isnan(values)
    first = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(values.T, present.T)])
    x, m = np.where(present, values - first, 0.0), present.astype(float)
    n, s, q = m.T @ m, x.T @ m, (x * x).T @ m
    safe = np.maximum(n, 1)
    spread = q - s * s / safe
    spread = np.where(spread <= ROUNDING * q, 0.0, spread)
    return n, np.where(n > 0, s / safe + first[:, None], 0.0), np.where(n > 0, s.T / safe + first[None, :], 0.0), spread, spread.T, \
        x.T @ x - s * s.T / safe


def merged(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    one_side = [np.where(a[0] == 0, q, np.where(b[0] == 0, p, p + d * share)) for p, q, d in ((a[1], b[1], dx), (a[2], b[2], dy))]
    return n, *one_side, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight


def _packed(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in m], names=list(PARTS))


def _unpacked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Moments]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].values.to_numpy().reshape(k, k) for c in batch.columns)


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the k x k matrices of ``PARTS`` as arrays, none for a table without rows."""
    k, schema = len(cols), ", ".join(f"{p} array<double>" for p in PARTS)
    rows = max(1, CHUNK_CELLS // k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = moments(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]))
                total = made if total is None else merged(total, made)
        if total is not None:
            yield _packed(total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for made in _unpacked(batches, k):
            total = made if total is None else merged(total, made)
        if total is not None:
            yield _packed(total)

    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # About as many tasks as a scan has partitions; the merge meets the square root of them.
    fan = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    made = with_workers(numbers).mapInArrow(products, schema)
    if fan > 1:
        made = made.repartition(fan).mapInArrow(together, schema)
    return made.repartition(1).mapInArrow(together, schema)


def pair_table(df: DataFrame, cols: Sequence[str], schema: str) -> DataFrame:
    """(pair_position, column1, column2, correlation) for every pair of columns in order; null if a side does not vary."""
    k = len(cols)
    names = list(cols)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = tuple(np.zeros((k, k)) for _ in PARTS)
        n, mx, my, xx, yy, xy = reduce(merged, _unpacked(batches, k), none)
        xx, yy = (np.where(v <= MERGE_ROUNDING * n * m * m, 0.0, v) for v, m in ((xx, mx), (yy, my)))
        i, j = np.triu_indices(k, 1)
        scale = np.sqrt(xx[i, j]) * np.sqrt(yy[i, j])
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(scale > 0, xy[i, j] / scale, np.nan)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(i)), pa.int32()), pa.array([names[x] for x in i], pa.string()),
             pa.array([names[x] for x in j], pa.string()), pa.array(r, pa.float64(), from_pandas=True)],
            names=["pair_position", "column1", "column2", "correlation"])

    return pair_moments(df, cols).repartition(1).mapInArrow(pairs, schema)
