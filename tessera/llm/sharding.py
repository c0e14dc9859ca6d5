"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset
and a step drawn from its name). Shards take turns; on its turn a shard claims
the first slot of its permutation that is still free. Every shard so owns an
equal number of slots to within one, and few slots change hands if a shard goes.
The table follows from the parameters alone, so it is filled once, where the plan is
made, and travels to the tasks as one literal array of table_size numbers, with the
plan. A row's key is hashed to a slot and its shard is read at that place of the
array: SQL expressions only, without a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: shards, and a prime of more than 100 slots a shard.
SHARDS, TABLE_SIZE = 32, 4099


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@lru_cache(maxsize=16)
def claim_slots(shards: tuple[str, ...], table_size: int = TABLE_SIZE) -> tuple[int, ...]:
    """The number of the shard that owns each slot. table_size must be a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if table_size < max(2, len(shards)) or any(table_size % p == 0 for p in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime of at least the number of shards")
    at = [_number(f"{x}:offset") % table_size for x in shards]
    steps = [_number(f"{x}:step") % (table_size - 1) + 1 for x in shards]
    owners = [-1] * table_size
    for turn in range(table_size):
        k = turn % len(shards)
        while owners[at[k]] >= 0:
            at[k] = (at[k] + steps[k]) % table_size
        owners[at[k]] = k
    return tuple(owners)


def _literal(values: Sequence[int | str], kind: str) -> Column:
    """The values as one array, folded to a literal of the plan."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def lookup_table(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per slot: (slot int, shard string)."""
    owners, names = _literal(claim_slots(tuple(shards), table_size), "int"), _literal(shards, "string")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.get(names, F.col("owner")).alias("shard"))


def assign_shards(rows: DataFrame, key: Sequence[str], shards: Sequence[str] | int = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """rows with two more columns, _slot int and _shard string, in constant time a row and without a shuffle.

    key: the columns that place a row; equal keys share a shard, so take a key
    without heavy values (a document id, not its source) where shards must be even.
    A null counts as a value of its own, apart from the empty string. Repeated
    rows land together; an empty table gives an empty one; further columns pass
    through, and an input column called _slot or _shard is replaced.
    """
    names = shard_names(shards) if isinstance(shards, int) else list(shards)
    rows = rows.drop("_slot", "_shard")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in key]
    digest = F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 8)
    placed = rows.withColumn("_slot", (F.conv(digest, 16, 10).cast("bigint") % table_size).cast("int"))
    owner = F.get(_literal(claim_slots(tuple(names), table_size), "int"), F.col("_slot"))
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], "_slot", F.get(_literal(names, "string"), owner).alias("_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, ["doc_id"]).select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def _duck(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT list(name ORDER BY i) AS names, list({_duck("name || ':offset'")} % {TABLE_SIZE} ORDER BY i) AS offsets,
         list({_duck("name || ':step'")} % {TABLE_SIZE - 1} + 1 ORDER BY i) AS steps
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({SHARDS}) t(i))),
fill(k, slots, following, taken) AS (
  SELECT 0::BIGINT, list_resize([]::BIGINT[], {TABLE_SIZE}, -1::BIGINT), list_resize([]::BIGINT[], {SHARDS}, 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT k + 1, slots[:p] || [k % {SHARDS}] || slots[p + 2:],
         following[:k % {SHARDS}] || [j + 1] || following[k % {SHARDS} + 2:], p
  FROM (SELECT *, (offsets[k % {SHARDS} + 1] + j * steps[k % {SHARDS} + 1]) % {TABLE_SIZE} AS p FROM (
    SELECT *, list_filter(range(following[k % {SHARDS} + 1], {TABLE_SIZE}),
      lambda j: slots[(offsets[k % {SHARDS} + 1] + j * steps[k % {SHARDS} + 1]) % {TABLE_SIZE} + 1] = -1)[1] AS j
    FROM fill, shards WHERE k < {TABLE_SIZE}))),
owned AS (SELECT (k - 1) % {SHARDS} AS owner, taken AS slot FROM fill WHERE k > 0)
SELECT doc_id, o.slot::INTEGER AS slot, 'shard-' || lpad(o.owner::VARCHAR, 5, '0') AS shard
FROM documents JOIN owned o ON o.slot = {_duck("coalesce('=' || doc_id::VARCHAR, '-')")} % {TABLE_SIZE}
"""
