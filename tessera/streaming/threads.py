"""Streaming form of a conversation's state (an extension): the latest state of each thread as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thread_state(messages: DataFrame) -> DataFrame:
    """Running state of each thread from a stream (conv_id, turn, role, text): messages so far and the last of them.

    Run with output mode 'update' or 'complete'; state is one row a thread.
    """
    last = F.max_by(F.struct("role", "text"), "turn")
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("turn"), last.alias("last")).select("conv_id", "n_messages", "turn", "last.role", "last.text")


def activity_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their sum by tumbling window and type, with a watermark for late data."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
