"""Sessions as rows: creation, listing, titles, activity, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import pick_ordinal, welcome

SCHEMA = (
    "session_id string, service_user_id string, title string, username string, user_role string, model_name string, embedding_name string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, message_count long"
)


def create_sessions(users: DataFrame, now: Column, model_name: str, embedding_name: str, session_id: Column | None = None) -> DataFrame:
    """A session for each row of users: no title, no message. Ids are drawn at random unless given."""
    at = now.cast("timestamp_ntz")
    return users.select(
        (F.uuid() if session_id is None else session_id).alias("session_id"), F.col("user_id").alias("service_user_id"), F.lit(None).cast("string").alias("title"), "username", "user_role",
        F.lit(model_name).alias("model_name"), F.lit(embedding_name).alias("embedding_name"), at.alias("created_at"), at.alias("updated_at"), F.lit(0).cast("long").alias("message_count"),
    )


def welcome_turns(sessions: DataFrame, language: str) -> DataFrame:
    """The first turn of new sessions, (session_id, question, created_at); it is saved without being counted and gives no title."""
    return sessions.select("session_id", welcome(F.lit(language)).alias("question"), "created_at")


def numbered(sessions: DataFrame) -> DataFrame:
    """sessions with their ordinal among those of their user, from 1 by (created_at, session_id)."""
    w = Window.partitionBy("service_user_id").orderBy("created_at", "session_id")
    return sessions.withColumn("ordinal", F.row_number().over(w))


def pick(sessions: DataFrame, choices: DataFrame) -> DataFrame:
    """(choice_id, session_id) of choices (choice_id, service_user_id, choice): the user's session at the ordinal typed, or null."""
    listed = numbered(sessions).groupBy("service_user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "session_id"))), lambda s: s["session_id"]).alias("ids"))
    return choices.join(listed, "service_user_id", "left").select("choice_id", pick_ordinal(F.col("choice"), F.col("ids")).alias("session_id"))


def retitle(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """sessions with the latest title of a log (session_id, title, seq); a later null takes a title away."""
    last = log.groupBy("session_id").agg(F.max_by(F.struct("title"), "seq").alias("_last"))
    title = F.when(F.col("_last").isNotNull(), F.col("_last.title")).otherwise(F.col("title")).alias("title")
    return sessions.join(last, "session_id", "left").select(*[title if c == "title" else F.col(c) for c in sessions.columns])


def auto_title(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """sessions whose null title becomes their first question of turns (session_id, message_id, question, created_at)."""
    first = turns.groupBy("session_id").agg(F.min_by("question", F.struct("created_at", "message_id")).alias("_first"))
    title = F.coalesce("title", "_first").alias("title")
    return sessions.join(first, "session_id", "left").select(*[title if c == "title" else F.col(c) for c in sessions.columns])


def with_activity(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """sessions with message_count and updated_at derived from turns (session_id, created_at)."""
    seen = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_at"))
    new = {"message_count": F.col("message_count") + F.coalesce("_n", F.lit(0)), "updated_at": F.greatest("updated_at", "_at")}
    return sessions.join(seen, "session_id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in sessions.columns])


def delete(sessions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and the rows that the deletion of ids (session_id) returns: null columns for an unknown id."""
    return sessions.join(ids, "session_id", "left_anti"), ids.select("session_id").distinct().join(sessions, "session_id", "left")


def status(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "message_count", "created_at", "updated_at")
