"""Merged profile states next to profiles of the whole table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import states as S

SCHEMA = "part string, `x.1` double, n int, t string, d date"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(r, n):
    import datetime
    return [(r.choice("abc"), None if r.random() < 0.1 else 1e6 + r.gauss(0, 2), r.randrange(5000), None if r.random() < 0.2 else "t" * r.randrange(9),
             datetime.date(2024, 1, 1 + r.randrange(28))) for _ in range(n)]


def test_merged_states_equal_the_state_of_the_union(spark):
    r = random.Random(1)
    rows = [*random_rows(r, 6000), *[("a", float("nan"), None, None, None)] * 5, *[("hot", 7.0, 1, "same", None)] * 9000]
    df = table(spark, rows).repartition(4)
    parts = S.grouped_states(df, "part", df.columns)
    merged = {x.column_name: x for x in S.profile_of_states(S.merge_states(parts)).collect()}
    whole = {x.column_name: x for x in S.profile_of_states(S.profile_state(df)).collect()}
    assert list(merged) and set(merged) == set(df.columns)
    x = np.array([v[1] for v in rows if v[1] is not None and not math.isnan(v[1])])
    assert merged["x.1"].null_count == len(rows) - len(x) and math.isclose(merged["x.1"].std, x.std(ddof=1), rel_tol=1e-12)
    for c in df.columns:
        for name in ("ordinal_position", "data_type", "total_rows", "null_count", "null_fraction", "min", "max", "min_text", "max_text",
                     "min_length", "max_length", "avg_length"):
            assert merged[c][name] == whole[c][name], (c, name)
        for name in ("avg", "std"):
            assert merged[c][name] == whole[c][name] or math.isclose(merged[c][name], whole[c][name], rel_tol=1e-12)
    numbers = [v[2] for v in rows if v[2] is not None]
    assert abs(merged["n"].distinct_count - len(set(numbers))) <= S.DISTINCT_ERROR * len(set(numbers))
    for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
        below, upto = np.mean(np.array(numbers) < merged["n"][name]), np.mean(np.array(numbers) <= merged["n"][name])
        assert below - S.RANK_ERROR <= p <= upto + S.RANK_ERROR


def test_only_new_partitions_are_profiled(spark, tmp_path):
    path = str(tmp_path / "states")
    assert S.stored_states(spark, path) is None
    r = random.Random(2)
    first, second = random_rows(r, 300), [("z", *x[1:]) for x in random_rows(r, 100)]
    S.append_states(table(spark, first), path, F.col("part"))
    # Rows of a stored partition are not read into it again, whatever they hold now.
    changed = [*first, ("a", 0.0, 0, "changed", None)]
    stored = S.append_states(table(spark, [*changed, *second, (None, 1.0, 1, "no partition", None)]), path, F.col("part"))
    rows = {(x.partition, x.column_name): x.total_rows for x in stored.collect()}
    for part in ("a", "b", "c", "z"):
        assert rows[part, "n"] == sum(x[0] == part for x in [*first, *second])
    assert rows[None, "n"] == 1
    again = S.append_states(table(spark, [*changed, *second, (None, 1.0, 1, "x", None)]), path, F.col("part"))
    assert again.count() == stored.count()
    drift = {x.partition: x for x in S.state_drift(again).filter("column_name = 'n'").collect()}
    means = {p: np.mean([x[2] for x in [*first, *second] if x[0] == p]) for p in "abcz"}
    assert drift[None].avg_change is None
    assert math.isclose(drift["b"].avg_change, means["b"] - means["a"]) and math.isclose(drift["z"].avg_change, means["z"] - means["c"])


def test_empty_and_missing(spark):
    empty = S.profile_of_states(S.profile_state(table(spark, []))).collect()
    assert len(empty) == 5 and all(x.total_rows == 0 and x.distinct_count == 0 and x.median is None for x in empty)
    missing = table(spark, [("a", None, None, None, None)] * 3)
    both = S.profile_state(missing).unionByName(S.profile_state(table(spark, [("b", 2.0, 3, "x", None)])))
    merged = {x.column_name: x for x in S.profile_of_states(S.merge_states(both)).collect()}
    assert merged["n"].null_count == 3 and merged["n"].avg == 3 and merged["n"].std is None and merged["n"].median == 3
    assert merged["d"].distinct_count == 0 and merged["t"].avg_length == 1
    assert S.merge_states(both.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["partition", "_partition", "stored", "p0"])
def test_columns_of_any_name(spark, tmp_path, name):
    df = spark.createDataFrame([(1, "a"), (2, "b")], f"`{name}` int, part string")
    stored = S.append_states(df, str(tmp_path / "s"), F.col("part"))
    assert sorted((x.partition, x.column_name, x.mean) for x in stored.filter(F.col("column_name") == name).collect()) == [
        ("a", name, 1.0), ("b", name, 2.0)]
