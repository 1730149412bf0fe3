"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablegauge.llm.common import with_workers

SHINGLE = 5
_rng = np.random.default_rng(20240601)
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, np.uint64)
WORD_FACTORS = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C13)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash over all 64 (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (A-Z in lower case), and the end of each text in that array."""
    return hash_words([(t or "").encode("utf-8", "surrogatepass") for t in texts], SPACES)


def hash_words(raw: Sequence[bytes], gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for UTF-8 texts whose words are the runs of bytes that are no ``gaps`` (a table over bytes; a space is one)."""
    data = np.frombuffer(b" ".join(raw).translate(LOWER) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    letter = ~gaps[data]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    sizes = stops - starts
    at = np.flatnonzero(letter)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), BASE, np.uint64)]).cumprod(dtype=np.uint64)
    hashes = np.add.reduceat(BYTE_VALUES[data[at]] * powers[place], first)
    return mix(hashes + sizes.astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_sets(texts: Sequence[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than five words is one shingle of all its words."""
    words, ends = word_hashes(texts)
    n = max(0, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += words[k:k + n] * WORD_FACTORS[k]
    grams = mix(total)
    out, start = [], 0
    for end in ends.tolist():
        size = end - start
        if size >= SHINGLE:
            out.append(np.unique(grams[start:end - SHINGLE + 1]))
        elif size:
            few = (words[start:end] * WORD_FACTORS[:size]).sum(dtype=np.uint64)
            out.append(mix(np.array([few], np.uint64) ^ np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def grouped(df: DataFrame, key: str, schema: str, fn, rows: int = 20_000) -> DataFrame:
    """``fn`` on tables that hold whole groups of ``key``, sorted by it: many small groups cost one call.

    A table has about ``rows`` rows, or more where a single group is larger; callers bound their groups.
    """
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(at).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
            if cut:
                yield from fn(table.slice(0, cut)).to_batches()
                table = table.slice(cut)
            held, count = table.to_batches(), 0
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return with_workers(df).repartition(key).sortWithinPartitions(key).mapInArrow(run, T.StructType.fromDDL(schema))
