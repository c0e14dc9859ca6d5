"""Namespaced key-value memory as an append-only log, and the views that read it.

A log has namespace array<string>, key, value, seq (total order of writes) and op ('put' or 'delete').
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The current entries: the last write of each (namespace, key), unless it deletes."""
    last = log.groupBy("namespace", "key").agg(F.max_by(F.struct("value", "seq", "op"), "seq").alias("e"))
    return last.where("e.op = 'put'").select("namespace", "key", "e.value", "e.seq")


def scan(entries: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """Entries whose namespace starts with prefix."""
    return entries.where(F.slice("namespace", 1, len(prefix)) == F.array(*map(F.lit, prefix)))


def delete_prefix(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Entries under none of prefixes (kind, session_id), the first two parts of a namespace."""
    parts = entries.withColumns({"_kind": F.get("namespace", F.lit(0)), "_session": F.get("namespace", F.lit(1))})
    on = (parts["_kind"] == prefixes["kind"]) & (parts["_session"] == prefixes["session_id"])
    return parts.join(prefixes, on, "left_anti").drop("_kind", "_session")


def history(turns: DataFrame, n: int, newest_first: bool = True) -> DataFrame:
    """The last n turns of each session with their rank; turns: (session_id, message_id, created_at, ...)."""
    order = [F.col("created_at").desc(), F.col("message_id").desc()] if newest_first else [F.col("created_at"), F.col("message_id")]
    return turns.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("rank") <= n)


def coerce(items: DataFrame) -> DataFrame:
    """Fills what a stored turn lacks: its ids from key and namespace, its time from the item's; an empty value or object counts as missing.

    items: (namespace, key, value, created_at, seq).
    """
    field = lambda name: F.nullif(F.get_json_object("value", f"$.{name}"), F.lit(""))
    return items.select(
        F.coalesce(field("message_id"), F.col("key")).alias("message_id"),
        F.coalesce(field("session_id"), F.get("namespace", F.lit(1))).alias("session_id"),
        F.coalesce(field("question"), F.lit("")).alias("question"),
        F.coalesce(field("created_at"), F.col("created_at")).alias("created_at"),
        F.coalesce(field("metadata"), F.lit("{}")).alias("metadata"),
        "seq",
    )
