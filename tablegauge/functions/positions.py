"""The row at a position of an order, without sorting the table.

A sample of the keys brackets each wanted position, one pass over the table counts the rows below and inside the
brackets, and the keys inside, a small part, are written once and searched again until they are few enough to be ordered
in place. The answer is exact whatever the sample was. Rows are told apart by a hash of all their columns after the given
order; what still ties is the same row, and a boundary inside such a tie carries the number of copies on either side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col
from tablegauge.session import materialize

SAMPLE_KEYS = 20_000
FEW_KEYS = 50_000
MARGIN = 4.0  # standard errors of a sampled position


@dataclass
class Boundary:
    """The key at a position: ``before`` rows have a smaller key, and ``copies`` rows with the same one lie before it."""

    key: Column
    before: int
    copies: int


def mean_before(value: Column, key: Column, boundary: Boundary | None) -> Column:
    """Mean of a column over the rows before a boundary, as an aggregate; over all rows without one."""
    value = value.cast("double")
    if boundary is None:
        return F.avg(value)
    own = F.max(F.when(key == boundary.key, value))
    some = F.when(own.isNotNull(), F.lit(boundary.copies)).otherwise(0)
    total = F.coalesce(F.sum(F.when(key < boundary.key, value)), F.lit(0.0)) + F.coalesce(own, F.lit(0.0)) * boundary.copies
    return F.try_divide(total, F.count(F.when(key < boundary.key, value)) + some)


def mean_after(value: Column, key: Column, boundary: Boundary) -> Column:
    """The same over the rows from the boundary on."""
    value = value.cast("double")
    own = F.max(F.when(key == boundary.key, value))
    some = F.when(own.isNotNull(), F.lit(boundary.copies)).otherwise(0)
    total = F.coalesce(F.sum(F.when(key >= boundary.key, value)), F.lit(0.0)) - F.coalesce(own, F.lit(0.0)) * boundary.copies
    return F.try_divide(total, F.count(F.when(key >= boundary.key, value)) - some)


def descending(number: Column) -> list[Column]:
    """Keys that put larger numbers first and nulls last."""
    return [number.isNull(), -number]


def row_key(df: DataFrame, order_by: Sequence[str | Column]) -> Column:
    """The order columns and a hash of the whole row as one comparable struct; nulls come first."""
    keys = [col(c) if isinstance(c, str) else c for c in order_by]
    wide = [x for f in df.schema for x in (
        F.to_json(F.struct(col(f.name))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name), col(f.name).isNull())]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(*wide).alias("h"))


def _literal(value, kind: T.DataType) -> Column:
    fields = [F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind]
    return F.struct(*fields)


def boundaries(df: DataFrame, key: Column, positions: Sequence[int], rows: int,
               sample_keys: int = SAMPLE_KEYS, few: int = FEW_KEYS) -> dict[int, Boundary]:
    """The boundary at each 0-based position below ``rows``, the number of rows; ``key`` is from ``row_key``.

    At most two keys and four counts a position reach the driver in every round.
    """
    wanted = sorted({p for p in positions if 0 <= p < rows})
    return _search(df.select(key.alias("key")), wanted, rows, sample_keys, few)


def _search(keys: DataFrame, positions: Sequence[int], rows: int, sample_keys: int, few: int) -> dict[int, Boundary]:
    if not positions:
        return {}
    kind, key = keys.schema["key"].dataType, F.col("key")
    if rows <= few:
        # Few keys: ordered in one array, and only the wanted ones leave it, with the place where their copies begin.
        held = keys.agg(F.array_sort(F.collect_list("key")).alias("a"))
        at = [F.element_at("a", p + 1) for p in positions]
        picked = held.select(F.array(*at).alias("k"), F.array(*[F.array_position("a", k) - 1 for k in at]).alias("b")).first()
        return {p: Boundary(_literal(k, kind), b, p - b) for p, k, b in zip(positions, picked["k"], picked["b"])}
    sample = keys.sample(fraction=min(1.0, sample_keys / rows), seed=17).agg(
        F.array_sort(F.collect_list("key")).alias("a"), F.count(F.lit(1)).alias("m"))
    ends = []
    for p in positions:
        at, q = F.lit((p + 0.5) / rows) * F.col("m"), p / rows
        reach = F.lit(MARGIN * math.sqrt(q * (1 - q))) * F.sqrt("m") + MARGIN
        ends += [F.try_element_at("a", place.cast("int")) for place in (
            F.greatest(F.floor(at - reach), F.lit(1)), F.least(F.ceil(at + reach), F.greatest("m", F.lit(1))))]
    picked = sample.select(F.array(*ends).alias("e")).first()["e"]
    low, high = ([None if x is None else _literal(x, kind) for x in picked[side::2]] for side in (0, 1))
    if low[0] is None:  # nothing was sampled
        return _search(keys, positions, rows, rows, few)
    within = [(key > a) & (key < b) for a, b in zip(low, high)]
    counts = keys.agg(*[F.count_if(x) for a, b, i in zip(low, high, within) for x in (key < a, key == a, i, key == b)]).first()
    out: dict[int, Boundary] = {}
    inside, others = [], []
    for j, p in enumerate(positions):
        below, at_low, between, at_high = counts[4 * j:4 * j + 4]
        at_high = 0 if picked[2 * j] == picked[2 * j + 1] else at_high
        start = below + at_low
        if p < below:
            others.append((p, key < low[j], 0, below))
        elif p < start:
            out[p] = Boundary(low[j], below, p - below)
        elif p < start + between:
            inside.append((p, j, start, between))
        elif p < start + between + at_high:
            out[p] = Boundary(high[j], start + between, p - start - between)
        else:
            others.append((p, key > high[j], start + between + at_high, rows - start - between - at_high))
    if inside:
        # Brackets may overlap; a key inside several of them is written once.
        kept = materialize(keys.filter(reduce(lambda a, b: a | b, [within[j] for _, j, _, _ in inside])), "position-keys")
        others = [*others, *((p, kept.filter(within[j]), start, between) for p, j, start, between in inside)]
    for p, part, start, size in others:
        side = part if isinstance(part, DataFrame) else keys.filter(part)
        found = _search(side, [p - start], size, sample_keys, few)[p - start]
        out[p] = Boundary(found.key, found.before + start, found.copies)
    return out
