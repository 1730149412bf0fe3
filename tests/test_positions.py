"""Rows at positions of an order, and correlations from one scan, next to plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.functions.gramian import merged, moments
from tablegauge.functions.positions import boundaries, descending, mean_after, mean_before, row_key
from tablegauge.operators import ask, evaluate, insights

KINDS = {"unique": lambda r, k: k, "ties": lambda r, k: r.randrange(5), "hot": lambda r, k: 7 if r.random() < 0.6 else r.randrange(1000),
         "constant": lambda r, k: 1, "nulls": lambda r, k: None if r.random() < 0.3 else r.randrange(40)}


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("few", [40, 100_000])
def test_boundaries(spark, kind, few):
    r = random.Random(kind)
    n = 400
    rows = [(KINDS[kind](r, k), float(r.randrange(3)) if kind == "constant" else float(k)) for k in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "o int, v double").repartition(3)
    key = row_key(df, ["o"])
    wanted = [0, 1, 57, 200, 399]
    found = boundaries(df, key, [*wanted, n, -1], n, sample_keys=60, few=few)
    assert sorted(found) == wanted
    order = [x.v for x in df.select(key.alias("k"), "v").orderBy("k").collect()]
    for p in wanted:
        low, high = df.agg(mean_before(F.col("v"), key, found[p]), mean_after(F.col("v"), key, found[p])).first()
        assert (low is None) == (p == 0) and (p == 0 or math.isclose(low, np.mean(order[:p])))
        assert math.isclose(high, np.mean(order[p:]))
        assert found[p].before + found[p].copies == p


def test_growth_trends_and_projection(spark):
    r = random.Random(3)
    values = [(k, 10.0 + k * 0.5 + r.gauss(0, 3), None if k % 7 == 0 else float(r.randrange(50)), 4) for k in range(301)]
    df = spark.createDataFrame(r.sample(values, len(values)), "`k.1` int, a double, b double, c int").repartition(5)
    pdf = pd.DataFrame(values, columns=["k.1", "a", "b", "c"])
    half = len(pdf) // 2
    growth = {x.column_name: x for x in insights.growth_metrics(df, ["k.1"]).collect()}
    slopes = {x.column_name: x for x in ask.linear_projection(df, ["k.1"]).collect()}
    for c in ("a", "b", "c"):
        early, late = pdf[c][:half].mean(), pdf[c][half:].mean()
        assert math.isclose(growth[c].growth_rate, (late - early) / early * 100, abs_tol=1e-9)
        kept = pdf[c].dropna()
        assert math.isclose(slopes[c].slope, np.polyfit(kept.index, kept, 1)[0], abs_tol=1e-9)
    assert math.isclose(slopes["a"].next_value, values[-1][1] + slopes["a"].slope)
    bands = {x.column_name: x.momentum for x in ask.trend_bands(df, ["k.1"]).collect()}
    assert bands["a"] == "accelerating" and bands["c"] == "decelerating"
    for empty in (df.limit(0), df.limit(1)):
        assert insights.growth_metrics(empty, ["k.1"]).collect() == [] and ask.linear_projection(empty, ["k.1"]).collect() == []


def test_top_shares(spark):
    r = random.Random(5)
    rows = [(k, None if k % 11 == 0 else float(r.randrange(6)), float(r.random() < 0.4)) for k in range(230)]
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    got = evaluate.top_share_metrics(spark.createDataFrame(rows, "k int, s double, y double").repartition(3), "s", "k", "y", 0.2, 50).first()
    y = [x[2] for x in order]
    assert math.isclose(got[0], np.mean(y[:46])) and math.isclose(got[1], np.mean(y[:50]))
    assert math.isclose(got[2], np.mean(y[:23]) / np.mean(y))


def test_moments_merge():
    r = np.random.default_rng(1)
    v = r.normal(1e6, 1, (3000, 6))
    v[:, 1] = 2 * v[:, 0] + r.normal(0, 0.1, 3000)
    v[:, 2] = 7.1
    v[r.random(v.shape) < 0.2] = np.nan
    v[:, 5] = np.nan
    total = None
    for part in np.array_split(v, 9):
        total = moments(part) if total is None else merged(total, moments(part))
    n, mx, my, xx, yy, xy = total
    assert np.allclose(n, (~np.isnan(v)).T.astype(float) @ ~np.isnan(v))
    assert (xx[2] == 0).all() and (n[5] == 0).all()
    assert abs((xy / np.sqrt(xx * yy))[0, 1] - pd.DataFrame(v).corr().iloc[0, 1]) < 1e-9


def test_correlations_read_a_wide_table_once(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame(r.normal(size=(400, 100)), columns=[f"c.{i}" for i in range(100)])
    pdf["c.1"] = pdf["c.0"] * 3 + r.normal(size=400) * 0.1
    pdf["c.2"] = 5.0
    pdf.iloc[::3, 3] = np.nan
    pdf.iloc[:, 4] = np.nan
    pairs = insights.pair_correlations(spark.createDataFrame(pdf).repartition(6))
    text = pairs._jdf.queryExecution().toString()
    assert text.split("== Physical Plan ==")[1].count("Scan") == 1
    got = {(x.column1, x.column2): x.correlation for x in pairs.collect()}
    want = pdf.corr()
    assert list(got)[:2] == [("c.0", "c.1"), ("c.0", "c.2")] and len(got) == 100 * 99 // 2
    for (a, b), value in got.items():
        expected = want.loc[a, b]
        assert value is None if math.isnan(expected) else abs(value - expected) < 1e-12
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert [x.correlation for x in insights.pair_correlations(one).collect()] == [None]
    assert [x.correlation for x in insights.pair_correlations(one.limit(0)).collect()] == [None]
