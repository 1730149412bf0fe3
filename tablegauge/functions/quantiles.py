"""Exact quantiles without holding a column's values in one task.

``percentile`` keeps every distinct value of a group in one hash map. Here a
sketch over a sample brackets each wanted rank, a counting pass over all rows
says how many values lie inside the bracket, and only those few are ranked.
Of brackets that are still too wide the values inside are written once, and
narrower brackets are taken from them; one that misses its rank is widened to
the whole range first. The result is exact whatever the sample was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col
from tablegauge.session import materialize

ACCURACY = 10_000
SAMPLE_ROWS = 200_000
MAX_RANKED = 1_000_000
# Columns aggregated together; more make the generated code too long to be fast.
COLUMNS_PER_PASS = 3


@dataclass
class _Target:
    column: str
    low_rank: int
    high_rank: int
    weight: float
    below: int = 0
    at_low: int = 0
    inside: int = 0
    low: float | None = None
    high: float | None = None
    values: tuple[float, float] | None = None

    def settle(self) -> None:
        """Fix the answer when the wanted ranks fall on the bracket's ends."""
        found = []
        for rank in (self.low_rank, self.high_rank):
            if rank < self.below + self.at_low:
                found.append(self.low)
            elif rank >= self.below + self.at_low + self.inside:
                found.append(self.high)
        if len(found) == 2:
            self.values = (found[0], found[1])


def _sample(df: DataFrame, rows: int, wanted: int, values: int, seed: int) -> tuple[DataFrame, float]:
    """About ``wanted`` of ``rows`` rows, which hold about ``values`` values of
    interest, and the margin in rank share that a bracket around a sampled
    quantile needs: five standard errors and the error of the sketch."""
    if wanted >= rows:
        return df, 3.0 / ACCURACY
    return df.sample(fraction=wanted / rows, seed=seed), 3.0 / ACCURACY + 2.5 / math.sqrt(values)


def _one_row(df: DataFrame, aggregates: dict[str, list[Column]]) -> dict[str, list]:
    """Values of like-typed aggregates per column.

    Columns are split over a few branches of one job; each branch reads only
    its own columns, so together they read the table once.
    """
    names = list(aggregates)
    parts = []
    for start in range(0, len(names), COLUMNS_PER_PASS):
        chunk = names[start:start + COLUMNS_PER_PASS]
        flat = [a for c in chunk for a in aggregates[c]]
        parts.append(df.agg(F.array(*flat).alias("values")).select(F.lit(start).alias("start"), "values"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = {}
    for r in rows.collect():
        values = iter(r["values"])
        for c in names[r["start"]:r["start"] + COLUMNS_PER_PASS]:
            found[c] = [next(values) for _ in aggregates[c]]
    return found


def _per_column(targets: list[_Target]) -> dict[str, list[_Target]]:
    grouped: dict[str, list[_Target]] = {}
    for t in targets:
        grouped.setdefault(t.column, []).append(t)
    return grouped


def _around(column: Column, shares: Sequence[float], margin: float) -> Column:
    probs = [min(1.0, max(0.0, p + side)) for p in shares for side in (-margin, margin)]
    return F.percentile_approx(column, probs, ACCURACY)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    sample_rows: int = SAMPLE_ROWS, max_ranked: int = MAX_RANKED) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, None for a column without values.

    Only one row per pass, and at most two values per quantile, reach the driver.
    """
    cols = list(cols)
    if not cols:
        return {}
    numbers = {c: col(c).cast("double") for c in cols}
    sizes = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(numbers.values())]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for i, c in enumerate(cols):
        n = sizes[f"n{i}"]
        for j, p in enumerate(probs if n else ()):
            position = (n - 1) * p
            low = math.floor(position + 1e-12)
            targets[c, j] = _Target(c, low, min(n - 1, low + 1), max(0.0, position - low))
    if targets:
        # A column with many missing values has fewer values in the sample.
        scarcest = min(sizes[f"n{i}"] for i in range(len(cols)) if sizes[f"n{i}"])
        wanted = math.ceil(sample_rows * sizes["n"] / scarcest)
        part, margin = _sample(df, sizes["n"], wanted, sample_rows, seed=11)
        held = [c for c in cols if (c, 0) in targets]
        sketched = _one_row(part, {c: [_around(numbers[c], probs, margin)] for c in held})
        for c in held:
            ends = sketched[c][0]
            for j in range(len(probs)):
                t = targets[c, j]
                t.low, t.high = (ends[2 * j], ends[2 * j + 1]) if ends else (-math.inf, math.inf)

    everything = list(targets.values())
    if everything:
        _count_brackets(df, everything)
    _rank_inside(df, [t for t in everything if t.values is None and t.inside <= max_ranked])
    _search_survivors(df, [t for t in everything if t.values is None], sample_rows, max_ranked)

    result: dict[str, list[float | None]] = {}
    for c in cols:
        found = [targets.get((c, j)) for j in range(len(probs))]
        result[c] = [None if t is None else t.values[0] + (t.values[1] - t.values[0]) * t.weight for t in found]
    return result


def _count_brackets(df: DataFrame, targets: list[_Target]) -> None:
    grouped, aggregates = _per_column(targets), {}
    for c, own in grouped.items():
        v = col(c).cast("double")
        aggregates[c] = []
        for t in own:
            aggregates[c] += [F.count_if(v < t.low), F.count_if(v == t.low)]
            if t.low != t.high:
                aggregates[c] += [F.count_if((v > t.low) & (v < t.high)), F.count_if(v == t.high)]
    counted, missed = _one_row(df, aggregates), []
    for t in (t for own in grouped.values() for t in own):
        counts = counted[t.column]
        t.below, t.at_low = counts.pop(0), counts.pop(0)
        t.inside, at_high = (counts.pop(0), counts.pop(0)) if t.low != t.high else (0, 0)
        if t.low_rank < t.below or t.high_rank >= t.below + t.at_low + t.inside + at_high:
            missed.append(t)
        else:
            t.settle()
    if missed:
        # Outside its sample's margin: start again from the whole range.
        ends = df.agg(*[f(F.col(t.column).cast("double")) for t in missed for f in (F.min, F.max)]).first()
        for i, t in enumerate(missed):
            t.low, t.high = ends[2 * i], ends[2 * i + 1]
        _count_brackets(df, missed)


def _search_survivors(df: DataFrame, targets: list[_Target], sample_rows: int, max_ranked: int) -> None:
    """Settle targets whose brackets are still too wide.

    The values inside the brackets, a small part of the table, are written once; all further brackets are taken from
    them, so the table itself is not read again.
    """
    if not targets:
        return
    kept = materialize(_inside(df, targets), "quantile-values")
    frame = kept.select(*[F.when(F.col("t") == i, F.col("v")).alias(f"q{i}") for i in range(len(targets))])
    found = []
    for i, t in enumerate(targets):
        start = t.below + t.at_low
        ranks = [min(max(r - start, 0), t.inside - 1) for r in (t.low_rank, t.high_rank)]
        found.append(_Target(f"q{i}", *ranks, t.weight, inside=t.inside, low=t.low, high=t.high))
    pending = found
    while pending:
        _narrow(frame, pending, sample_rows)
        _count_brackets(frame, pending)
        wide = [t for t in pending if t.values is None and t.inside > max_ranked]
        _rank_inside(frame, [t for t in pending if t.values is None and t.inside <= max_ranked])
        pending = wide
    for t, own in zip(targets, found):
        start = t.below + t.at_low
        t.values = (t.low if t.low_rank < start else own.values[0],
                    t.high if t.high_rank >= start + t.inside else own.values[1])


def _narrow(df: DataFrame, targets: list[_Target], sample_rows: int) -> None:
    """Closer brackets for the ranks among the values strictly inside the old ones."""
    if not targets:
        return
    total, fewest = df.count(), min(t.inside for t in targets)
    part, margin = _sample(df, total, math.ceil(sample_rows * total / fewest), sample_rows, seed=13)
    grouped, aggregates = _per_column(targets), {}
    for c, own in grouped.items():
        v = col(c).cast("double")
        aggregates[c] = []
        for t in own:
            start = t.below + t.at_low
            shares = [min(1.0, max(0.0, (r - start) / t.inside)) for r in (t.low_rank, t.high_rank)]
            ends = [max(0.0, shares[0] - margin), min(1.0, shares[1] + margin)]
            aggregates[c].append(F.percentile_approx(F.when((v > t.low) & (v < t.high), v), ends, ACCURACY))
    sketched = _one_row(part, aggregates)
    for t in (t for own in grouped.values() for t in own):
        start = t.below + t.at_low
        ends = sketched[t.column].pop(0)
        if ends is None:
            continue
        low, high = ends
        # Keep an end of the old bracket when one of the two ranks sits on it.
        t.low = t.low if t.low_rank < start else low
        t.high = t.high if t.high_rank >= start + t.inside else high


def _inside(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """(t, v): the values strictly inside the bracket of each target, by its position in the list."""
    number = {id(t): i for i, t in enumerate(targets)}
    parts = []
    for c, own in _per_column(targets).items():
        v = col(c).cast("double")
        inside = [(v > t.low) & (v < t.high) for t in own]
        wanted = inside[0]
        for more in inside[1:]:
            wanted = wanted | more
        # Each branch reads one column, and few of its rows pass the filter.
        hits = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(number[id(t)]).alias("t"), v.alias("v"))) for t, cond in zip(own, inside)]))
        parts.append(df.filter(wanted).select(F.inline(hits)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _rank_inside(df: DataFrame, targets: list[_Target]) -> None:
    if not targets:
        return
    found = _inside(df, targets)
    counted = found.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    # At most max_ranked values per target reach this window.
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("v"))
    start = F.element_at(F.array(*[F.lit(t.below + t.at_low) for t in targets]), F.col("t") + 1)
    low = F.element_at(F.array(*[F.lit(t.low_rank) for t in targets]), F.col("t") + 1)
    high = F.element_at(F.array(*[F.lit(t.high_rank) for t in targets]), F.col("t") + 1)
    ranked = counted.withColumn("upto", upto + start).withColumn("since", F.col("upto") - F.col("n"))
    picked = ranked.groupBy("t").agg(
        F.max(F.when((low >= F.col("since")) & (low < F.col("upto")), F.col("v"))).alias("a"),
        F.max(F.when((high >= F.col("since")) & (high < F.col("upto")), F.col("v"))).alias("b"))
    for r in picked.collect():
        t = targets[r["t"]]
        # A rank on an end of the bracket is not among the candidates.
        first = r["a"] if r["a"] is not None else t.low
        second = r["b"] if r["b"] is not None else t.high
        t.values = (first, second)


def iqr_bounds(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.75)):
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR per column, and the quantiles themselves."""
    quantiles = exact_quantiles(df, cols, probs)
    bounds = {}
    for c, q in quantiles.items():
        if q[0] is None:
            bounds[c] = (None, None)
        else:
            spread = q[-1] - q[0]
            bounds[c] = (q[0] - 1.5 * spread, q[-1] + 1.5 * spread)
    return bounds, quantiles


def outside(column: Column, bounds: tuple[float | None, float | None]) -> Column:
    """Strictly outside the bounds; never for a column without values."""
    if bounds[0] is None:
        return F.lit(False)
    return (column < F.lit(bounds[0])) | (column > F.lit(bounds[1]))
