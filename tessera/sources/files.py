"""Sources and sinks: indexes and tables as Parquet, configuration and questions as JSON, optional JDBC."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SEARCH_TYPES = ("similarity", "mmr", "similarity_score_threshold")


@dataclass(frozen=True)
class SearchConfig:
    type: str = "similarity"
    kwargs: dict[str, Any] = field(default_factory=dict)
    filename: str | tuple[str, ...] | None = None
    fusion: bool = False

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> SearchConfig:
        kind = config.get("type", "similarity")
        if kind not in SEARCH_TYPES:
            raise ValueError(f"unknown search type {kind!r}")
        kwargs = {"k": config.get("top_k", 3)} | {x: config[x] for x in ("fetch_k", "score_threshold") if config.get(x) is not None}
        name = config.get("filename")
        return cls(kind, kwargs, tuple(name) if isinstance(name, list) else name, bool(config.get("fusion")))


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at path, or None if there is none; any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_config(path: str, app_id: str) -> dict[str, Any]:
    """One application's section of a JSON configuration file on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)[app_id]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def config_snapshot(config: dict[str, Any], hidden: tuple[str, ...] = ("password", "api_key", "token")) -> dict[str, Any]:
    """A configuration as it is stored beside results: nested values kept, secrets starred, other objects as text."""

    def plain(name: str, value: Any) -> Any:
        if name in hidden:
            return "***"
        if isinstance(value, dict):
            return {k: plain(k, v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain("", v) for v in value]
        return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)

    return plain("", config)
