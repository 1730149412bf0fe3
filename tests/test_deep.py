"""Change points, autocorrelations and frequent combinations next to plain loops."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tablegauge.functions import ordered
from tablegauge.functions.columns import with_row_index
from tablegauge.operators import deep


def series_of(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "bucket bigint, value double")


def segmented(values, penalty=3.0, least=5):
    x = np.array([0.0 if v is None else v for v in values])
    steps = [(b - a) ** 2 for a, b in zip(values, values[1:]) if a is not None and b is not None]
    bar = penalty * math.log(len(x)) * np.mean(steps) / 2
    out, open_ = [], [(0, len(x), 1)]
    while open_:
        lo, hi, turn = open_.pop()
        best = None
        for i in range(lo + least, hi - least + 1):
            a, b = x[lo:i].mean(), x[i:hi].mean()
            gain = (i - lo) * (hi - i) / (hi - lo) * (a - b) ** 2
            if best is None or gain > best[1] + 1e-9:
                best = (i, gain, a, b)
        if best and best[1] > bar:
            i = best[0]
            out.append((i - 1, i, lo, hi, round(best[2], 6), round(best[3], 6), round(best[1], 4), turn))
            open_ += [(lo, i, turn + 1), (i, hi, turn + 1)]
    return sorted(out)


def points(df):
    return sorted((r.bucket, r.position, r.segment_start, r.segment_end, round(r.mean_before, 6), round(r.mean_after, 6),
                   round(r.error_reduction, 4), r["round"]) for r in df.collect())


def test_change_points(spark, monkeypatch):
    monkeypatch.setattr(deep, "SEGMENT_BLOCK", 32)
    r = random.Random(4)
    values = [level + r.gauss(0, 1) for level, n in ((0, 90), (6, 40), (-3, 70), (-3.2, 30), (9, 25), (4, 60)) for _ in range(n)]
    got = points(deep.change_points(series_of(spark, values).repartition(5)))
    assert got == segmented(values) and len(got) >= 4
    values[17] = None
    assert points(deep.change_points(series_of(spark, values))) == segmented(values)


@pytest.mark.parametrize("values", [[], [1], [3] * 9, [1, 5] * 2, [0] * 4 + [9] * 4, [2] * 40])
def test_series_without_change_points(spark, values):
    assert deep.change_points(series_of(spark, values)).collect() == []


def correlated(values, lag):
    known = [v for v in values if v is not None]
    mean = sum(known) / len(known)
    x = [None if v is None else v - mean for v in values]
    s = sum(a * b for a, b in zip(x, x[lag:]) if a is not None and b is not None)
    return s / sum(a * a for a in x if a is not None)


@pytest.mark.parametrize("block", [8, 4096])
def test_block_autocorrelations(spark, block):
    r = random.Random(block)
    values = [math.sin(k / 24 * 2 * math.pi) + r.gauss(0, 0.3) for k in range(203)]
    values[50] = None
    lags = [1, 2, 7, 8, 9, 24, 63, 64, 100, 195, 202]
    got = {x.lag: x.autocorrelation for x in deep.block_autocorrelations(series_of(spark, values).repartition(3), lags, block).collect()}
    assert sorted(got) == lags
    assert all(abs(got[lag] - correlated(values, lag)) < 1e-9 for lag in lags)


def test_seasonality_of_all_and_of_chosen_lags(spark):
    values = [math.sin(k / 12 * 2 * math.pi) for k in range(120)]
    every = deep.block_autocorrelations(series_of(spark, values)).collect()
    assert sorted(x.lag for x in every) == list(range(2, 61))
    assert deep.seasonality(series_of(spark, values)).first().lag == 12
    assert deep.seasonality(series_of(spark, values), lags=[24, 30]).first().lag == 24
    assert deep.block_autocorrelations(series_of(spark, [])).collect() == []
    assert deep.block_autocorrelations(series_of(spark, [1.0]), [5]).collect() == []


def frequent(rows, cols, support, least=2):
    out = set()
    for k in range(least, len(cols) + 1):
        for part in combinations(range(len(cols)), k):
            seen = Counter(tuple(row[i] for i in part) for row in rows if all(row[i] is not None for i in part))
            out |= {(k, ",".join(cols[i] for i in part), " & ".join(f"{cols[i]}={v}" for i, v in zip(part, value)), n)
                    for value, n in seen.items() if n >= support * len(rows)}
    return out


@pytest.mark.parametrize("sets", [2, 100])
def test_frequent_itemsets(spark, monkeypatch, sets):
    monkeypatch.setattr(deep, "PASS_SETS", sets)
    r = random.Random(sets)
    cols = ["a", "b.c", "n", "_k", "code"]
    rows = []
    for _ in range(600):
        hot = r.random() < 0.4
        rows.append(("x" if hot else r.choice("xyz"), None if r.random() < 0.1 else ("h" if hot else r.choice("hij")),
                     1 if hot else r.randrange(4), "k" if hot else f"u{r.randrange(10**6)}", r.choice(["p", "q"])))
    df = spark.createDataFrame(rows, "a string, `b.c` string, n int, _k string, code string").repartition(4)
    got = deep.frequent_itemsets(df, cols, 0.05).collect()
    assert {(x.size, x.columns, x.combination, x.n) for x in got} == frequent(rows, cols, 0.05)
    assert len(got) == len({x.combination for x in got}) and max(x.size for x in got) == 5
    assert all(abs(x.support - x.n / 600) < 1e-12 for x in got)
    alone = deep.frequent_itemsets(df, ["a", "n"], 0.3, least_size=1).collect()
    assert {(x.size, x.columns, x.combination, x.n) for x in alone} == frequent([(x[0], x[2]) for x in rows], ["a", "n"], 0.3, 1)


def test_frequent_itemsets_of_small_tables(spark):
    df = spark.createDataFrame([("a", "b"), (None, None)], "x string, y string")
    assert deep.frequent_itemsets(df.limit(0), ["x", "y"]).collect() == []
    assert deep.frequent_itemsets(df, []).collect() == [] and deep.frequent_itemsets(df, ["x"]).collect() == []
    assert [x.combination for x in deep.frequent_itemsets(df, ["x", "y"], 0.5).collect()] == ["x=a & y=b"]
    assert deep.frequent_itemsets(df, ["x", "y"], 0.6).collect() == []
    with pytest.raises(ValueError):
        deep.frequent_itemsets(df, ["x"], 0)


def test_row_index_keeps_columns_of_any_name(spark):
    rows = [(k % 3, f"t{k}", k, -k, 2 * k, k) for k in range(50)]
    df = spark.createDataFrame(rows, "`a.b` int, _tie string, _part int, _pos int, _start int, _TIE_ int").repartition(4)
    got = with_row_index(df, ["a.b", "_pos"], "place").orderBy("place")
    assert got.columns == [*df.columns, "place"]
    assert [tuple(r) for r in got.collect()] == [(*row, i) for i, row in enumerate(sorted(rows, key=lambda r: (r[0], r[3])))]


def test_running_totals_cross_blocks(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(40)], "i bigint, v double").repartition(3)
    got = ordered.running_total(df, {"s": "v"}, index="i", block=7).orderBy("i").collect()
    assert [r.s for r in got] == [float(sum(range(k + 1))) for k in range(40)]
