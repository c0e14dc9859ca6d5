"""Users as rows: creation, lookup, activity. A change gives a new DataFrame; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "user_id string, username string, user_role string, email string, created_at timestamp_ntz, last_active timestamp_ntz"


def create_users(requests: DataFrame, now: Column, user_id: Column | None = None, role: str = "user") -> DataFrame:
    """One user for each request (username, email), both times set to now. Ids are drawn at random unless given."""
    at = now.cast("timestamp_ntz")
    made = (F.uuid() if user_id is None else user_id).alias("user_id")
    return requests.select(made, "username", F.lit(role).alias("user_role"), "email", at.alias("created_at"), at.alias("last_active"))


def get_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, found, user_id, ...): the user that each request (request_id, user_id, username, email) names.

    The id decides before the name, the name before the address; the first by (created_at, user_id) of several is
    taken. A request without any of them is an error, with found null; one that finds nobody has found false.
    """
    kinds = ("user_id", "username", "email")
    first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("name"))) for k in kinds])
    any_given = F.greatest(*[F.coalesce(F.length(k), F.lit(0)) for k in kinds]) > 0
    asked = requests.select("request_id", F.when(any_given, first).alias("by")).select("request_id", "by.kind", "by.name")
    by = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds])).alias("by")
    named = users.select("*", by).where("by.name is not null")
    w = Window.partitionBy("kind", "name").orderBy("created_at", "user_id")
    one = named.select(*users.columns, "by.kind", "by.name").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    joined = asked.join(one, ["kind", "name"], "left")
    return joined.select("request_id", F.when(F.col("kind").isNotNull(), F.col("user_role").isNotNull()).alias("found"), *users.columns)


def touch(users: DataFrame, activity: DataFrame) -> DataFrame:
    """users with last_active moved to their latest activity (user_id, at); activity of unknown users is ignored."""
    latest = activity.groupBy("user_id").agg(F.max(F.col("at").cast("timestamp_ntz")).alias("_at"))
    moved = F.greatest("last_active", "_at").alias("last_active")
    return users.join(latest, "user_id", "left").select(*[moved if c == "last_active" else F.col(c) for c in users.columns])
