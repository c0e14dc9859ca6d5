"""Batch evaluation: guidelines of questions to rows, and answers back under their guidelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUESTION = "array<struct<id:string,question:string>>"
SCHEMA = f"guidelines map<string, struct<guideline_name:string, questions:{QUESTION}>>"


def flatten(source: DataFrame) -> DataFrame:
    """(guideline, guideline_name, pos, id, question); a guideline without questions is left out."""
    named = source.select(F.explode("guidelines").alias("guideline", "g"))
    asked = named.select("guideline", "g.guideline_name", F.posexplode("g.questions").alias("pos", "q"))
    return asked.select("guideline", "guideline_name", "pos", "q.id", "q.question")


def with_defaults(questions: DataFrame) -> DataFrame:
    """Missing ids become Q_<number in the flat order>, missing texts empty, missing guidelines 'unknown'.

    Questions are numbered within their guideline; only the guidelines' sizes are ordered as a whole.
    """
    own = F.row_number().over(Window.partitionBy("guideline").orderBy("pos"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("guideline").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = questions.groupBy("guideline").agg(F.count(F.lit(1)).alias("size")).select(F.col("guideline").alias("_g"), before.alias("_before"))
    numbered = questions.withColumn("_n", own).join(sizes, F.col("guideline").eqNullSafe(F.col("_g")))
    number = F.col("_n") + F.col("_before")
    return numbered.select(
        F.coalesce("guideline", F.lit("unknown")).alias("guideline"), "guideline_name", "pos", F.coalesce("id", F.concat(F.lit("Q_"), number.cast("string"))).alias("id"), F.coalesce("question", F.lit("")).alias("question")
    )


def answered(rows: DataFrame) -> DataFrame:
    """answer, or the error as 'ERROR: ...'."""
    return rows.withColumn("answer", F.coalesce("answer", F.concat(F.lit("ERROR: "), F.col("error"))))


def regroup(answers: DataFrame) -> DataFrame:
    """One row a guideline, its answers in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "question", "answer")))
    return answers.groupBy("guideline", "guideline_name").agg(rows.alias("questions"))
