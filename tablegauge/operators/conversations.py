"""Conversation tables: listings, threads, role runs and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, with_row_index
from tablegauge.functions.ordered import BLOCK_ROWS, back_window, running_total, with_halo

TITLE_LENGTH = 50


def list_conversations(conversations: DataFrame, messages: DataFrame, key: str = "conv_id",
                       at: str = "updated_at") -> DataFrame:
    """Conversations with their number of messages, newest first."""
    counts = messages.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"))
    return conversations.join(counts, key, "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0).cast("bigint"))).orderBy(col(at).desc(), key)


def threads(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages in reading order with their position in the thread.

    Rows stay rows: a conversation of any length is sorted over several tasks
    and never gathered into one array.
    """
    indexed = with_row_index(messages, [key, turn])
    starts = indexed.groupBy(key).agg(F.min("row_index").alias("_start"))
    return indexed.join(starts, key).withColumn("position", F.col("row_index") - F.col("_start")).drop(
        "_start", "row_index")


def role_runs(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
              block: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive messages of one role as one row each.

    A run starts where the conversation or the role differs from the row
    before; a running count of starts numbers the runs.
    """
    indexed = with_row_index(messages.select(key, turn, role), [key, turn])
    w = back_window((key,))
    starts = (
        with_halo(indexed, 1, block=block)
        .withColumn("_start", F.when(F.lag(role).over(w).eqNullSafe(col(role)), 0).otherwise(1))
        .filter(~F.col("_halo")).drop("_halo", "_block"))
    runs = running_total(starts, {"run": "_start"}, block=block)
    grouped = runs.groupBy(key, "run", role).agg(
        F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count(F.lit(1)).alias("messages"))
    return grouped.drop("run")


def conversation_titles(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The first user message cut to 50 characters, with dots if cut."""
    first = messages.filter(F.col("role") == "user").groupBy(key).agg(F.min_by("text", turn).alias("t"))
    return first.select(key, F.concat(
        F.substring("t", 1, TITLE_LENGTH), F.when(F.length("t") > TITLE_LENGTH, "...").otherwise("")).alias("title"))
