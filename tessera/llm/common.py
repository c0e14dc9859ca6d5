"""Shared by the operators: reading documents, and walking Arrow batches in bounded pieces."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import small_batches

#: Bytes of text that a Python operator holds decoded at once (a longer document is a piece of its own).
PIECE_BYTES = 1 << 20
#: Bytes of a section of a long text, and of a table that is broadcast at most.
SECTION_BYTES, BROADCAST_BYTES = 1 << 20, 32 << 20
#: ASCII white space, that separates words.
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows so that a piece has about limit bytes in column. At the end the worker gives freed memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
    _give_back()


def _give_back() -> None:
    """Returns what Arrow and the C library hold without using it; a worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores before it until no column of taken has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sections(data: bytes, limit: int = SECTION_BYTES) -> Iterator[bytes]:
    """data in parts of about limit bytes that end at ASCII white space, so that no word is cut; a longer word is whole."""
    at = 0
    while len(data) - at > limit:
        end = SPACES.search(data, at + limit)
        if end is None:
            break
        yield data[at : end.end()]
        at = end.end()
    yield data[at:] if at else data


def fits(rows: DataFrame, width: Column | int) -> bool:
    """Whether rows, of width bytes each beside about 32 for the row itself, may be broadcast. rows is read once: pass a checkpoint."""
    total = rows.agg(F.sum(F.lit(width) + 32 if isinstance(width, int) else F.coalesce(width, F.lit(0)) + 32)).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def sent(rows: DataFrame, width: Column | int) -> DataFrame:
    """rows, marked for a broadcast where their measured size allows it; joined by a shuffle otherwise."""
    return F.broadcast(rows) if fits(rows, width) else rows


def fold_by_key(rows: DataFrame, keys: Sequence[str], value: str, add: Callable[[Any, bytes], Any], finish: Callable[[Any], bytes], order: Sequence[str] = ()) -> DataFrame:
    """(keys, value): of each key its binary values folded one after another, so that a task holds one key's state whatever the number of rows."""
    rows = rows.select(*keys, value)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            done = []
            for *key, data in zip(*(batch.column(c).to_pylist() for c in (*keys, value)), strict=True):
                if key != own:
                    if own is not None:
                        done.append((*own, finish(state)))
                    own, state = key, None
                state = add(state, data)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True) if done else [[]] * len(batch.schema), batch.schema, strict=True)], schema=batch.schema)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*own, finish(state)), batch.schema, strict=True)], schema=batch.schema)

    return dealt.mapInArrow(run, rows.schema)
