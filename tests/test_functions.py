"""Building blocks against pandas, on skewed and awkward data."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.functions.ordered import back_window, running_total, with_halo
from tablegauge.functions.quantiles import exact_quantiles
from tablegauge.session import materialize, scratch


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows hold one value; NaN, None and a constant column too."""
    rng = np.random.default_rng(3)
    n = 6000
    hot = np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 10, n).round(2))
    hot[::97] = np.nan
    return pd.DataFrame({
        "id": np.arange(n), "hot": hot, "whole": rng.integers(-50, 50, n), "flat": 7.0,
        "wide": rng.lognormal(3, 2, n), "key": np.where(rng.random(n) < 0.4, "a", rng.choice(list("bcdef"), n))})


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("sample_rows,max_ranked", [(200_000, 1_000_000), (300, 1_000_000), (300, 20), (50, 5)])
def test_quantiles_equal_pandas(spark, skewed, sample_rows, max_ranked):
    cols = ["hot", "whole", "flat", "wide"]
    df = C.nan_to_null(spark.createDataFrame(skewed))
    found = exact_quantiles(df, cols, PROBS, sample_rows=sample_rows, max_ranked=max_ranked)
    for c in cols:
        assert found[c] == pytest.approx(list(skewed[c].quantile(PROBS)), rel=1e-12), c


def test_quantiles_of_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (5.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [1.75, 3.0], "b": [None, None]}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    one = df.limit(1)
    assert exact_quantiles(one, ["a"], [0.25, 1.0]) == {"a": [1.0, 1.0]}


def test_row_index_is_the_sorted_position(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(7)
    got = C.with_row_index(df, ["whole", "id"]).toPandas().sort_values("row_index")
    want = skewed.sort_values(["whole", "id"])
    assert list(got.row_index) == list(range(len(skewed)))
    assert list(got.id) == list(want.id)


def test_row_index_spreads_equal_keys(spark):
    df = spark.range(4000).withColumn("k", F.lit(1))
    indexed = C.with_row_index(df, ["k"])
    assert sorted(r.row_index for r in indexed.collect()) == list(range(4000))


def test_halo_windows_and_running_totals_over_small_blocks(spark, skewed):
    df = C.with_row_index(spark.createDataFrame(skewed).select("key", "id", "wide"), ["key", "id"])
    w = back_window(["key"])
    lagged = (with_halo(df, 7, block=64)
              .withColumn("lag7", F.lag("wide", 7).over(w))
              .withColumn("roll", F.avg("wide").over(w.rowsBetween(-6, 0)))
              .filter("NOT _halo"))
    total = running_total(df, {"upto": "wide"}, ["key"], block=64).toPandas().sort_values("id")
    got = lagged.toPandas().sort_values("id")
    by = skewed.sort_values(["key", "id"]).groupby("key").wide
    assert np.allclose(got.lag7, by.shift(7).sort_index(), equal_nan=True)
    assert np.allclose(got.roll, by.rolling(7, min_periods=1).mean().droplevel(0).sort_index())
    assert np.allclose(total.upto, by.cumsum().sort_index())


def test_column_counts_by_type(spark):
    rows = [(1, 0.0, "a", True), (1, -0.0, "b", True), (None, float("nan"), None, None), (2, 2.5, "b", False)]
    df = C.nan_to_null(spark.createDataFrame(rows, "i int, d double, s string, b boolean").withColumn(
        "t", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).withColumn("m", F.lit("2024-01-01").cast("date")))
    got = {r.column_name: (r.distinct_count, r.value_count, r.top_count) for r in C.column_counts(df, df.columns).collect()}
    assert got == {"i": (2, 3, 2), "d": (2, 3, 2), "s": (2, 3, 2), "b": (2, 3, 2), "t": (1, 4, 4), "m": (1, 4, 4)}


def test_scratch_block_deletes_what_it_made(spark):
    with scratch(spark):
        path = materialize(spark.range(10), "owned").inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)
