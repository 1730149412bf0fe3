"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. In the order of size and id, the running sum of
these expected copies starts at one random offset per source, and a document is emitted once for each integer that the
sum crosses at it. Sorted by size, the words taken differ from the target by about the size of one document.

Positions come from one range sort of thin rows (``with_row_index``), never from a window over a source, so a source
with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import with_row_index
from tablegauge.llm.common import as_row, col, join_groups, store

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_COPIES = 2
OFFSET_STEPS = 1 << 20


def words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a join key; null is a source of its own."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def water_level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight such that targets min(2 size, level x weight) sum to the budget."""
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * MAX_COPIES <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, F.col("source_size") * MAX_COPIES).otherwise(0)).alias("size"),
                          F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
                          F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == capped or not got["weight"]:
            return level
        level, capped = (budget - got["size"]) / got["weight"], got["n"]


def mix(df: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id",
        carry: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, share: float = BUDGET) -> DataFrame:
    """How often each document enters the mix.

    Returns ``row`` (the carried columns, all by default), ``size`` long (words), ``source_size`` long, ``target``
    double (of its source), ``copies`` long (0 to 2) and ``taken`` long (``copies`` x ``size``). Sources in code point
    order, null last, have the weights in turn and share ``share`` times all words; a target is at most twice its
    source's size and what is over is shared again by weight. The same rows give the same copies in any partitioning.
    Null text has size 0; an empty table gives an empty result; of rows equal in size and id any may be the one taken.
    """
    sized = df.select(as_row(df.columns if carry is None else carry), col(source).cast("string").alias("source"),
                      words(col(text)).alias("size"), col(ident).alias("ident"))
    order = [F.col("source").asc_nulls_last(), "size", "ident"]
    placed = with_row_index(sized, order, "place")
    found = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("start"),
                                         F.count(F.lit(1)).alias("n"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = store(with_row_index(store(found, "mix-sources"), [F.col("source").asc_nulls_last()], "nth").select(
        source_key(F.col("source")).alias("key"), "source_size", "start", "n", turn.cast("long").alias("weight")), "mix-weights")
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("n").alias("rows")).first()
    level = water_level(ranked, share * (total["words"] or 0))
    targets = ranked.select(
        "key", "source_size", "start", "n",
        F.least(F.col("source_size").cast("double") * MAX_COPIES, F.lit(level) * F.col("weight")).alias("target"),
        (F.conv(F.substring(F.md5("key"), 1, 5), 16, 10).cast("double") / OFFSET_STEPS).alias("offset"))
    joined = join_groups(placed.withColumn("key", source_key(F.col("source"))), targets, "key", "n", total["rows"] or 0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nth = F.col("place") - F.col("start")
    crossed = F.floor(F.col("offset") + (nth + 1) * rate) - F.floor(F.col("offset") + nth * rate)
    copies = F.least(F.greatest(crossed, F.lit(0).cast("long")), F.lit(MAX_COPIES).cast("long"))
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each carried row as often as it is taken."""
    return mixed.filter("copies > 0").select(
        "row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
