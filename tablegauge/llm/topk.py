"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights; its components are the terms. Candidates are packed in blocks, each with
a posting list per term (places and weights). For a block of queries, every term scatters the products of its query
weights and its postings into a dense score array; a partition selection takes the best of the block, and the best of
all blocks are merged, first within a task and then per query.

Queries are packed in blocks too and reach the candidates in rounds of bounded size, so neither side is ever whole in
one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import col, store, with_workers

SCALE = 256
CANDIDATE_ROWS, QUERY_ROWS = 2048, 256  # rows of a packed block
BLOCK_VALUES = 1 << 18  # components of a packed block; a longer vector is a block of its own
ROUND_BLOCKS = 64  # query blocks broadcast at a time on average: at most 64 x 2 MB of components
EXACT_KEY = 1 << 51  # scores under it leave room for a block's places in one 64-bit sort key

PACKED = "n int, ids binary, numbers binary, sizes binary, terms binary, weights binary"


def weights_of(vector: Column) -> Column:
    """floor(256 x) of every component as bigint, or null if the vector is null or has a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(doubles, lambda x: F.floor(x * SCALE).cast("bigint")))


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of (id, number, weights) rows; zero weights are left out. Ids ascend within a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        values = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: r[:2])
            dense = [np.asarray(r[2], np.int64) for r in held]
            terms = [np.flatnonzero(d).astype(np.int32) for d in dense]
            return pa.RecordBatch.from_pydict({
                "n": [len(held)], "ids": [np.array([r[0] for r in held], np.int64).tobytes()],
                "numbers": [np.array([r[1] for r in held], np.int64).tobytes()],
                "sizes": [np.array([len(t) for t in terms], np.int32).tobytes()],
                "terms": [np.concatenate(terms).tobytes()],
                "weights": [np.concatenate([d[t] for d, t in zip(dense, terms)]).tobytes()]}, schema=schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= rows or values + len(row[2]) > BLOCK_VALUES):
                    yield flush()
                    held, values = [], 0
                held.append(row)
                values += len(row[2])
        if held:
            yield flush()

    schema = pa.schema([("n", pa.int32()), *[(f, pa.binary()) for f in ("ids", "numbers", "sizes", "terms", "weights")]])
    return with_workers(vectors).select("id", "number", "weights").mapInArrow(run, PACKED)


def postings(block: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and weights of each term of a block."""
    sizes = np.frombuffer(block["sizes"], np.int32)
    terms = np.frombuffer(block["terms"], np.int32)
    weights = np.frombuffer(block["weights"], np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(terms, kind="stable")
    terms, weights, rows = terms[order], weights[order], rows[order]
    cuts = np.flatnonzero(np.diff(terms, prepend=-1))
    return {int(terms[a]): (rows[a:b], weights[a:b]) for a, b in zip(cuts, [*cuts[1:], len(terms)])}


def accumulate(queries: dict, candidates: dict, n_queries: int, n_candidates: int) -> np.ndarray:
    """Scores of every query and candidate of two blocks, one term after the other."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    for term, (q, w) in queries.items():
        if term in candidates:
            c, v = candidates[term]
            if len(c) == n_candidates:
                for i, x in zip(q.tolist(), w.tolist()):
                    scores[i] += x * v
            else:
                for i, x in zip(q.tolist(), w.tolist()):
                    scores[i, c] += x * v
    return scores


def select(scores: np.ndarray, valid: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the k best valid candidates of each query; of equal scores the first places."""
    n = scores.shape[1]
    if k < n and np.abs(scores).max(initial=0) < EXACT_KEY // n:
        keys = scores * n - np.arange(n)
        keys[~valid] = np.iinfo(np.int64).min
        best = np.argpartition(keys, n - k, axis=1)[:, n - k:]
        order = np.argsort(-np.take_along_axis(keys, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        return [b[valid[i, b]] for i, b in enumerate(best)]
    out = []
    for row, fine in zip(scores, valid):
        at = np.flatnonzero(fine)
        out.append(at[np.argsort(-row[at], kind="stable")[:k]])
    return out


def top_k(df: DataFrame, is_query: Column, vector: str = "embedding", ident: str = "vec_id", k: int = 5) -> DataFrame:
    """The k best candidates of every query row.

    Returns ``query_id`` long, ``rank`` int from 1, ``vec_id`` long and ``score`` long. A weight is floor(256 x); the
    score is the inner product of weights in 64-bit integers (larger ones wrap around), terms one vector lacks count 0. Every row but the query's
    own is a candidate; equal scores go to the smaller id. Rows with a null id, a null vector or a null or non-finite
    component take no part. Each row that repeats an id is a query or candidate of its own. With fewer than k
    candidates all are given; an empty table gives an empty result.
    """
    rows = df.select(col(ident).cast("bigint").alias("id"), is_query.alias("is_query"), weights_of(col(vector)).alias("weights"))
    rows = store(rows.filter("id IS NOT NULL AND weights IS NOT NULL").withColumn("number", F.monotonically_increasing_id()), "vectors")
    candidates = store(pack(rows, CANDIDATE_ROWS), "vector-blocks")
    queries = store(pack(rows.filter("is_query"), QUERY_ROWS).withColumn(
        "round", F.xxhash64(F.monotonically_increasing_id(), "ids")), "query-blocks")
    rounds = max(1, -(-queries.count() // ROUND_BLOCKS))
    names = ("n", "ids", "numbers", "sizes", "terms", "weights")
    left = candidates.select(F.struct(*names).alias("c"), F.lit(0).alias("side"))
    out_schema = pa.schema([("query_id", pa.int64()), ("number", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()),
                            ("score", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Best so far per query block (keyed by the rows in it): arrays of score, id and number. Bounded by the round.
        best: dict[bytes, tuple] = {}
        last, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                c, q = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if c["numbers"] != last:
                    last, held = c["numbers"], postings(c)
                own = np.frombuffer(q["numbers"], np.int64)
                numbers, ids = np.frombuffer(c["numbers"], np.int64), np.frombuffer(c["ids"], np.int64)
                scores = accumulate(postings(q), held, q["n"], c["n"])
                picked = select(scores, own[:, None] != numbers[None, :], k)
                old = best.get(q["numbers"])
                lists = []
                for j, at in enumerate(picked):
                    new = np.stack([-scores[j, at], ids[at], numbers[at]])
                    if old is not None:
                        new = np.concatenate([old[1][j], new], axis=1)
                        new = new[:, np.lexsort((new[2], new[1], new[0]))[:k]]
                    lists.append(new)
                best[q["numbers"]] = (np.frombuffer(q["ids"], np.int64), lists)
        for key, (ids, lists) in best.items():
            sizes = [x.shape[1] for x in lists]
            flat = np.concatenate(lists, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                np.repeat(ids, sizes), np.repeat(np.frombuffer(key, np.int64), sizes), flat[1], flat[2], -flat[0])], schema=out_schema)

    found = None
    for r in range(rounds):
        part = queries.filter(F.pmod("round", F.lit(rounds)) == r).select(F.struct(*names).alias("q"), F.lit(0).alias("side"))
        pairs = left.join(F.broadcast(part), "side").select("c", "q")
        one = pairs.mapInArrow(score, T.StructType([T.StructField(f.name, T.LongType()) for f in out_schema]))
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
