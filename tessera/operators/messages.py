"""Message lists: merging them by id, and the last ones of each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_messages(left: Column, right: Column) -> Column:
    """left with the messages of right: one whose id left has replaces that one in its place, others are appended in order.

    Messages are structs with an id; of several in right with one id the last counts. A null list is empty.
    """
    none = lambda m: F.lit(False)
    old, new = F.coalesce(left, F.filter(right, none)), F.coalesce(right, F.filter(left, none))
    last = F.filter(new, lambda m, i: ~F.exists(F.slice(new, i + 2, F.size(new)), lambda n: n["id"] == m["id"]))
    kept = F.transform(old, lambda m: F.coalesce(F.get(F.filter(last, lambda n: n["id"] == m["id"]), F.lit(0)), m))
    return F.concat(kept, F.filter(last, lambda n: ~F.exists(old, lambda m: m["id"] == n["id"])))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation (conv_id, turn), ranked before anything is gathered."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
