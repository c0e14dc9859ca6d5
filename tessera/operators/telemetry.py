"""Records of a turn in the key-value memory: conversation, retrieval, model call, feedback.

A turn is a request and its response in one row: session_id, message_id, question, created_at, response,
sources (array of structs), n_gen, contextual_question, duration (seconds), error. Every record is a put of the
memory's log (see tessera.operators.memory), its value a JSON object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import normalize_uuid
from tessera.operators import memory

NAMESPACES = ("conversation", "retrieval", "llm", "feedback")
LOG = "namespace array<string>, key string, value string, seq long, op string"


def _put(rows: DataFrame, namespace: list[Column], key: Column, value: Column) -> DataFrame:
    return rows.select(F.array(*namespace).alias("namespace"), key.alias("key"), F.to_json(value, {"ignoreNullFields": "false"}).alias("value"), F.col("seq").cast("long").alias("seq"), F.lit("put").alias("op"))


def _id(name: str) -> Column:
    return normalize_uuid(F.col(name))


def conversation_turns(turns: DataFrame) -> DataFrame:
    metadata = F.struct("sources", "n_gen", "contextual_question")
    value = F.struct(_id("message_id").alias("message_id"), _id("session_id").alias("session_id"), "question", metadata.alias("metadata"), "response", F.col("created_at").cast("string").alias("created_at"), "error")
    return _put(turns, [F.lit("conversation"), _id("session_id")], _id("message_id"), value)


def retrieval_turns(turns: DataFrame, embedding_name: str) -> DataFrame:
    value = F.struct(_id("message_id").alias("message_id"), _id("session_id").alias("session_id"), "question", "sources", F.lit(embedding_name).alias("embedding_name"))
    return _put(turns, [F.lit("retrieval"), _id("session_id"), _id("message_id")], F.lit("results"), value)


def llm_turns(turns: DataFrame, model_name: str, temperatures: dict[str, float], tokens: Column) -> DataFrame:
    """tokens counts what the turn used; the duration's seconds are stored under the name latency_ms, as readers expect them."""
    heat = [F.lit(float(temperatures.get(role, 0))).alias(f"{role}_temperature") for role in ("generator", "router", "grader")]
    value = F.struct(_id("message_id").alias("message_id"), _id("session_id").alias("session_id"), F.lit(model_name).alias("model_name"), *heat, tokens.alias("token_used"), F.round("duration", 2).alias("latency_ms"))
    return _put(turns, [F.lit("llm"), _id("session_id"), _id("message_id")], F.lit("results"), value)


def feedback_turns(feedback: DataFrame) -> DataFrame:
    """feedback: (session_id, message_id, user_id, feedback_value, feedback_message, created_at, seq). The key holds no user: the last writer wins."""
    value = F.struct(*[_id(c).alias(c) for c in ("message_id", "session_id", "user_id")], "feedback_value", "feedback_message", F.col("created_at").cast("string").alias("created_at"))
    return _put(feedback, [F.lit("feedback"), _id("session_id")], _id("message_id"), value)


def save_agent_turns(turns: DataFrame, embedding_name: str, model_name: str, temperatures: dict[str, float], tokens: Column) -> DataFrame:
    """The three records of each turn, to be appended to the log."""
    return reduce(DataFrame.unionByName, [conversation_turns(turns), retrieval_turns(turns, embedding_name), llm_turns(turns, model_name, temperatures, tokens)])


def delete_sessions(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entries left when sessions (session_id) are deleted from all four namespaces."""
    gone = sessions.select(F.explode(F.array(*map(F.lit, NAMESPACES))).alias("kind"), _id("session_id").alias("session_id"))
    return memory.delete_prefix(entries, gone)


def setup(spark: SparkSession, path: str) -> None:
    """An empty log at path, unless there is one."""
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(path)


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
