"""The registry of named queries and helpers to write them and their SQL checks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.sql import sql_over

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 4):
    """Register a query; floating results are rounded so both engines agree."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = fn(spark, sf_dir)
            return result if digits is None else rounded(result, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    scale = F.lit(float(10 ** digits))
    # Scale, round, unscale: the same double arithmetic as the SQL engine's round.
    return df.select(*[
        (F.round(F.col(c).cast("double") * scale) / scale + F.lit(0.0)).alias(c) if c in floats else F.col(c)
        for c in df.columns])


def rnd(sql: str, *cols: str, digits: int = 4) -> str:
    """The same rounding for the SQL side."""
    swaps = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def each(template: str, values: Iterable, glue: str = " UNION ALL ") -> str:
    """The template once per value; ``{c}`` is the value and ``{i}`` its position."""
    return glue.join(template.format(c=v, i=i) for i, v in enumerate(values))


def sql_on(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A SQL text over supplied tables, without leaving views behind."""
    return sql_over(spark, text, {t: load(spark, sf_dir, t) for t in tables})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
