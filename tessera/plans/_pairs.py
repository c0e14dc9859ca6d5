"""Queries whose text Spark and DuckDB share, or that differ only in a function's dialect."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("conversations", "events", "documents", "labels", "embeddings", "benchmark", "pages")


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that text names in braces."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return query


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], text)
