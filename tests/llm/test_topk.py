import math
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import topk
from tablegauge.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, weights int"


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, a) in enumerate(fine):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for c, (j, b) in enumerate(fine) if c != q)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())


def vectors(n, dims, seed):
    rng = random.Random(seed)
    hot = [rng.randrange(-256, 256) / 256 for _ in range(dims)]
    return [(i, hot if rng.random() < 0.3 else [rng.choice([0.0, rng.randrange(-512, 512) / 512]) for _ in range(dims)])
            for i in range(n)]


@pytest.mark.parametrize("rows,queries,blocks", [(2048, 256, 64), (7, 2, 1)])
def test_random(spark, monkeypatch, rows, queries, blocks):
    for name, value in (("CANDIDATE_ROWS", rows), ("QUERY_ROWS", queries), ("ROUND_BLOCKS", blocks)):
        monkeypatch.setattr(topk, name, value)
    data = vectors(220, 8, 1)
    assert run(spark, data) == brute(data)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf]), (4, [None, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [1.0]), (50, [-0.001, 0.0]), (50, [-0.001, 0.0]), (100, []), (8, [1e6] * 3)]
    assert run(spark, data) == brute(data)
    assert run(spark, [(50, [1.0])]) == [] and run(spark, []) == []


def test_large_scores_stay_exact(spark):
    data = [(i, [float((i * 7919) % 1000) * 5e3, 5e6]) for i in range(60)]
    assert run(spark, data) == brute([(i, v) for i, v in data])
