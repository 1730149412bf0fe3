"""Read-only SQL over registered tables, and the same rules as an audit of a query log."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.columns import col
from tablegauge.session import materialize
from tablegauge.sources.rows import rows_between

MAX_PAGE = 1000
STATEMENT_SECONDS = 30.0
_views = threading.RLock()  # views of a session are shared by its threads

# Words a read-only statement must not contain, and the refusals.
FORBIDDEN_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT",
    "REVOKE", "EXECUTE", "EXEC", "CALL", "MERGE", "REPLACE", "RENAME", "COMMENT")
ONLY_SELECT = "Only SELECT queries are allowed"
FORBIDDEN_PREFIX = "Query contains forbidden keyword: "
ONE_STATEMENT = "Multiple statements are not allowed"


def audit_queries(log: DataFrame, text: str) -> DataFrame:
    """Add ``allowed`` and ``reason`` (NULL if allowed) for each query text.

    Comments are removed only to find the first word. Forbidden words count
    wherever they stand, in comments and literals too, and so does ``;``.
    """
    upper = F.upper(F.trim(text))
    bare = F.trim(F.regexp_replace(F.regexp_replace(upper, r"--[^\n]*(\n|$)", ""), r"(?s)/\*.*?\*/", ""), F.lit(" \n\r\t"))
    reads = bare.startswith("SELECT") | bare.startswith("WITH")
    statements = F.size(F.filter(F.split(text, ";"), lambda s: F.trim(s, F.lit(" \n\r\t")) != ""))
    reason = F.when(col(text).isNull() | ~reads, ONLY_SELECT)
    # The first forbidden word of the text, as in refusal().
    found = F.regexp_extract(upper, r"\b(" + "|".join(FORBIDDEN_WORDS) + r")\b", 1)
    reason = reason.when(found != "", F.concat(F.lit(FORBIDDEN_PREFIX), found))
    reason = reason.when(statements > 1, ONE_STATEMENT)
    return log.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def refusal(text: str) -> str | None:
    """Why one query text is refused, or None. Same rules as ``audit_queries``."""
    bare = re.sub(r"(?s)/\*.*?\*/", "", re.sub(r"--[^\n]*(\n|$)", "", text)).strip().upper()
    if not bare.startswith(("SELECT", "WITH")):
        return ONLY_SELECT
    found = re.search(r"\b(" + "|".join(FORBIDDEN_WORDS) + r")\b", text, re.IGNORECASE)
    if found:
        return FORBIDDEN_PREFIX + found.group(1).upper()
    if sum(bool(part.strip()) for part in text.split(";")) > 1:
        return ONE_STATEMENT
    return None


def guarded_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The result of one read-only statement.

    ``tables`` are visible to the statement under their names; without them
    the catalog's tables are used. The caller's own views stay as they were.
    """
    reason = refusal(text)
    if reason:
        raise ValueError(reason)
    statement = text.strip().rstrip(";")
    return sql_over(spark, statement, tables or {})


def sql_over(spark: SparkSession, statement: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of a statement over the given frames.

    They are temporary views only while the statement is analysed; views of the same names, in any case, are put back.
    Two names that differ in case only are one view for Spark, and an error here.
    """
    if len({name.lower() for name in tables}) < len(tables):
        raise ValueError("table names must differ in more than case")
    hidden = {}
    with _views:
        for name, df in tables.items():
            if any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables(pattern=name)):
                hidden[name] = spark.table(name)
            df.createOrReplaceTempView(name)
        try:
            return spark.sql(statement)
        finally:
            for name in tables:
                if name in hidden:
                    hidden[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Interrupt the Spark work of the block after so many seconds and raise ``TimeoutError``; no limit for None.

    Jobs that this thread starts inside the block carry a tag of their own, and only those are cancelled: the session and
    what other threads run in it go on.
    """
    if seconds is None:
        yield
        return
    tag, late, done = f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while not done.is_set():  # jobs that start after the first interrupt end as well
            context.cancelJobsWithTag(tag)
            done.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the statement took longer than {seconds:g} seconds") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise TimeoutError(f"the statement took longer than {seconds:g} seconds")


def sql_page(spark: SparkSession, text: str, page: int = 1, page_size: int = 100,
             tables: Mapping[str, DataFrame] | None = None, order_by: Sequence[str] = (),
             seconds: float | None = None) -> DataFrame:
    """One page of a statement's result with the total number of rows.

    Later pages need ``order_by``, columns of the result; rows that tie there are
    ordered by their values, so that pages neither overlap nor leave rows out.
    The result is stored once, and count and page are taken from it. A statement that takes longer than ``seconds`` is
    ended with ``TimeoutError`` (interactive use: ``STATEMENT_SECONDS``; by default there is no limit, for large tables).
    """
    if not 1 <= page_size <= MAX_PAGE or page < 1:
        raise ValueError(f"page must be at least 1 and page_size between 1 and {MAX_PAGE}")
    if page > 1 and not order_by:
        raise ValueError("pages after the first need order_by")
    with time_limit(spark, seconds):
        stored = materialize(guarded_sql(spark, text, tables), "sql-result")
    total: Column = stored.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return rows_between(stored, order_by, (page - 1) * page_size, page_size).withColumn("total_rows", total)
