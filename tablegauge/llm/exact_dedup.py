"""Exact dedup by two-pass Bloom filtering.

Pass 1 builds a filter of hash positions that occur at least twice: every task sends the positions it saw once and
the ones it saw again, in segments of 65,536 bits with two bytes a position, and each segment is merged on its own.
Pass 2 probes the filter: rows whose positions are all marked may be repeated and are grouped by their SHA-256; the
rest are unique for certain and pass straight through without a shuffle. False positives only shuffle a row more.

The filter has 16 bits a row, up to ``FILTER_BITS`` (16 MB when broadcast). Beyond some 10 million rows it fills up
and more unique rows take part in the grouping; the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import as_row, col, join_groups, store, with_workers

FILTER_BITS = 1 << 27
SEGMENT = 1 << 16
FLUSH_ROWS = 1 << 20


def fingerprints(df: DataFrame, text: str, keep: str, carry: Sequence[str]) -> DataFrame:
    """Stored rows: the carried columns, the digest of the whole text, its hash, the rank value and the row's number."""
    digest = F.unhex(F.sha2(F.coalesce(col(text).cast("string"), F.lit("")).cast("binary"), 256))
    return store(df.select(as_row(carry), digest.alias("digest"), F.xxhash64(digest).alias("hash"),
                           col(keep).alias("rank"), F.monotonically_increasing_id().alias("number")), "exact-rows")


def filter_bits(rows: int) -> int:
    """Bits of a filter for so many rows: 16 a row, a power of two."""
    return min(FILTER_BITS, max(2 * SEGMENT, 1 << (16 * max(rows, 1) - 1).bit_length()))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, words) of the positions that occur twice or more; each hash has one position in either half."""
    half = bits // 2

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            cut = np.flatnonzero(np.diff(at >> 16, prepend=-1))
            rows = {"segment": [], "once": [], "again": []}
            for p, t in zip(np.split(at, cut[1:]), np.split(times, cut[1:])):
                low = (p & (SEGMENT - 1)).astype(np.uint16)
                rows["segment"].append(int(p[0] >> 16))
                rows["once"].append(low[t == 1].tobytes())
                rows["again"].append(low[t > 1].tobytes())
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("segment", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]))

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held += [(h % np.uint64(half)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(half)).astype(np.int64) + half]
            n += len(h)
            if n >= FLUSH_ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(SEGMENT, np.uint8)
        for once, again in zip(table["once"].to_pylist(), table["again"].to_pylist()):
            at = np.frombuffer(once, np.uint16)
            seen[at] = np.minimum(seen[at] + 1, 2)
            seen[np.frombuffer(again, np.uint16)] = 2
        words = np.packbits(seen > 1, bitorder="little").view(np.int64)
        return pa.table({"segment": table["segment"][:1], "words": pa.array([words.tolist()], pa.list_(pa.int64()))})

    sent = with_workers(hashes).select("hash").mapInArrow(positions, "segment int, once binary, again binary")
    return store(sent.groupBy("segment").applyInArrow(merge, "segment int, words array<bigint>"), "exact-filter")


def _unsigned_mod(c, n: int):
    """``c`` as an unsigned 64-bit number modulo a power of two."""
    return c.bitwiseAND(F.lit(n - 1))


def may_repeat(rows: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``maybe``: whether every position of its hash is marked."""
    half = bits // 2
    marks = F.broadcast(filter_)
    places = {"a": _unsigned_mod(F.col("hash"), half),
              "b": _unsigned_mod(F.shiftrightunsigned("hash", 32), half) + F.lit(half)}
    out, maybe = rows, F.lit(True)
    for name, at in places.items():
        side = marks.select(F.col("segment").alias(f"segment_{name}"), F.col("words").alias(f"words_{name}"))
        out = out.withColumn(f"at_{name}", at).join(
            side, F.shiftright(F.col(f"at_{name}"), 16).cast("int") == F.col(f"segment_{name}"), "left")
        low = F.col(f"at_{name}").bitwiseAND(F.lit(SEGMENT - 1)).cast("int")
        word = F.element_at(f"words_{name}", F.shiftright(low, 6) + 1)
        maybe = maybe & (F.coalesce(F.getbit(word, low.bitwiseAND(F.lit(63))), F.lit(0)) == 1)
    return out.select(*rows.columns, maybe.alias("maybe"))


def exact_dedup(df: DataFrame, text: str = "text", keep: str = "doc_id", carry: Sequence[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (the carried columns, all by default), ``keep_value`` (``keep`` of the row that
    stays), ``group_size`` long, ``kept`` boolean and ``digest`` (SHA-256 of the text).

    Texts are equal when identical; null counts as empty. The row with the largest ``keep`` stays (null is smallest);
    of rows that also tie there, exactly one stays. An empty table gives an empty result.
    """
    rows = fingerprints(df, text, keep, df.columns if carry is None else carry)
    total = rows.count()
    bits = filter_bits(total)
    probed = may_repeat(rows, repeated_filter(rows, bits), bits)
    alone = probed.filter(~F.col("maybe")).select(
        "row", F.col("rank").alias("keep_value"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    shared = probed.filter("maybe")
    groups = store(shared.groupBy("digest").agg(
        F.max(F.struct("rank", "number")).alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = join_groups(shared, groups, "digest", "group_size", total)
    return alone.unionByName(joined.select(
        "row", F.col("best.rank").alias("keep_value"), "group_size",
        (F.col("best.number") == F.col("number")).alias("kept"), "digest"))
