"""Connected components of a link table, by alternating large-star and small-star contractions.

A table of at most SMALL links is done by one task with a union-find: the rounds would cost more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed


#: Links that one task takes at most (about 100 bytes of memory each).
SMALL = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every node and the least one it is linked with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (u, v, m) with m the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node reachable.

    Nodes are integers. Nulls and links of a node to itself are ignored. Beyond small links, each round is a few
    aggregations and joins on node ids; its result is written to the checkpoint
    folder, so lineage stays short. The number of rounds is about the logarithm of
    the longest path.
    """
    pairs = checkpointed(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    seen = _mark(pairs)
    if seen[0] <= small:
        return checkpointed(pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, component long"))
    for _ in range(rounds):
        if not seen[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
