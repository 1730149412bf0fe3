"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut may fall after a byte where the low bits of the gear hash ``h = (h << 1) + G[byte]`` are zero. Only 16 bits of it
are used, so the last 16 bytes decide, and after an insertion the cuts meet again within a chunk or two. A cut comes
no sooner than ``LEAST`` bytes after the last and at the latest after ``MOST``; chunks of ``JUDGED`` bytes or more are
deduplicated by digest, shorter ones only occur at the end of a text and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import as_row, col, join_groups, map_texts, store

WINDOW = 16
MASK = (1 << 5) - 1  # a cut every 32 bytes after the least length, on average
LEAST, MOST, JUDGED = 32, 256, 32
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "little") for b in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash modulo 2^16 after each byte: sums over 1, 2, 4, 8 and 16 bytes by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint16(step) if step < len(h) else h[:0]
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n == 0:
        return []
    # The bits just under the top depend on the most bytes.
    candidates = np.flatnonzero((gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint16(11)) & np.uint16(MASK) == 0) + 1
    out, last = [], 0
    for c in candidates.tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunk_dedup(df: DataFrame, text: str = "text", ident: str = "doc_id", carry: Sequence[str] | None = None) -> DataFrame:
    """Find chunks that occurred before, in a row with a smaller ``ident`` or earlier in the same text.

    Returns ``row`` (the carried columns, all by default), ``n_bytes``, ``n_chunks``, ``n_repeated``, ``n_removed``
    (bytes of the repeated chunks) and ``removed``, their [start, end) byte spans in order. Texts are UTF-8 bytes; null
    counts as empty and has no chunk. Rows that repeat an ``ident`` are ordered as they are read, a null one comes
    first. An empty table gives an empty result.
    """
    source = df.select(as_row(df.columns if carry is None else carry), col(text).cast("string").alias("text"),
                       col(ident).alias("ident"), F.monotonically_increasing_id().alias("number"))

    def run(texts):
        sizes, ends, digests = [], [], []
        for t in texts:
            data = (t or "").encode()
            stops = cuts(data)
            starts = [0, *stops[:-1]]
            sizes.append(len(data))
            ends.append(stops)
            digests.append([hashlib.blake2b(data[a:b], digest_size=16).digest() if b - a >= JUDGED else None
                            for a, b in zip(starts, stops)])
        return [pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))]

    made = store(map_texts(source, "text", ["row", "ident", "number"], "n_bytes bigint, ends array<bigint>, digests array<binary>",
                           lambda: run), "chunks")
    chunks = made.select("row.ident", "row.number", F.posexplode("digests").alias("nth", "digest")).filter("digest IS NOT NULL")
    repeated = store(chunks.groupBy("digest").agg(
        F.min(F.struct("ident", "number", "nth")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-chunks")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    again = join_groups(chunks, repeated, "digest", "n", total).filter(
        (F.col("first.number") != F.col("number")) | (F.col("first.nth") != F.col("nth")))
    places = again.groupBy("number").agg(F.array_sort(F.collect_list("nth")).alias("again"))
    joined = made.select("row.row", "row.number", "n_bytes", "ends").join(places, "number", "left")
    start = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("ends", F.greatest(i, F.lit(1))))
    spans = F.transform(F.coalesce("again", F.array().cast("array<int>")), lambda i: F.struct(
        start(i).alias("start"), F.element_at("ends", i + 1).alias("end")))
    return joined.select("row", "n_bytes", F.size("ends").cast("long").alias("n_chunks"), spans.alias("removed")).select(
        "row", "n_bytes", "n_chunks", F.size("removed").cast("long").alias("n_repeated"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"), "removed")
