"""Removal of repeated passages: windows of WINDOW words that also start earlier.

A window's anchor is the leftmost least of its hashed SHINGLE-word shingles. Equal
windows have equal anchors at different places, so a window occurs at most as often as
its anchor's value does, at different places. First pass: each task keeps a count-min
sketch of the anchors of its texts, ROWS rows of 2**bits cells, and the tasks' sketches are
merged cell by cell, in blocks. The least of a value's cells can only overestimate.
The sketch's width follows the input's size up to 2**MAX_BITS, so what is broadcast is bounded: of each row
one bit a cell, set where it counts two or more. Second pass: only windows estimated
repeated are hashed in full (to a digest of their words, told apart by it and the anchor together) and grouped exactly. Each task
first settles its own repeats, so that a window met in a thousand copies is shuffled
once a task, and the rest are compared in order of document and place. Windows meet by
their anchor; those whose anchor is estimated to occur HEAVY times or more meet by anchor
and digest together, so that the many different windows around one common passage
are spread over the tasks, and a task holds a bounded part of any group.

A long text is read in sections that overlap by a window less one word, so a task's memory doesn't follow
the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_by_key, free_name, pieces, raw, sections, table
from tessera.session import checkpointed

#: Words of a window and of a shingle within it.
WINDOW, SHINGLE = 20, 8
#: Rows of the sketch, bits of a cell's number at least and at most, bytes of text for one cell, bits of a block in which sketches are merged.
ROWS, MIN_BITS, MAX_BITS, CELL_TEXT, BLOCK_BITS = 2, 16, 29, 16, 16
#: Estimated occurrences from which an anchor is heavy, bits of the bitmap of heavy ones, and rows of a group that a task compares at once.
HEAVY, HEAVY_BITS, GROUP_ROWS = 512, 24, 1 << 16
#: Bits of the bitmap of texts with spans, for each of them.
MARK_BITS = 16
#: Bytes of text that a task holds as arrays at once.
TEXT_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of several texts, side by side: where each starts and ends in buffer, and whose it is."""

    def __init__(self, data: list[bytes]):
        normal = [b" ".join(x.split()) for x in data]
        self.buffer = b" ".join(compress(normal, normal))
        chars = np.frombuffer(self.buffer, np.uint8)
        space = np.flatnonzero(chars == 32)
        none = np.empty(0, np.int64)
        self.start = np.concatenate([[0], space + 1]) if len(chars) else none
        self.end = np.concatenate([space, [len(chars)]]) if len(chars) else none
        self.count = np.fromiter((x.count(b" ") + 1 if x else 0 for x in normal), np.int64, len(normal))
        self.first = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(data)), self.count)
        self.chars = chars

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.chars)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n))]) if n else np.zeros(1, np.uint64)
        return _mix((total[self.end] - total[self.start]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[self.start])

    def windows(self, size: int) -> np.ndarray:
        """The words at which a window of size words starts."""
        last = len(self.start) - size + 1
        if last <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.text[:last] == self.text[size - 1 :])


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each width neighbours, and the leftmost place of it."""
    v, at, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < width:
        step = min(reach, width - reach)
        right = v[step:] < v[: len(v) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        v = np.where(right, v[step:], v[: len(v) - step])
        reach += step
    return v, at


def anchors(words: Words, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the word it starts at, its anchor's value, and the word its anchor starts at."""
    where = words.windows(window)
    if not len(where):
        return where, where.astype(np.uint64), where
    h, n = words.hashes(), len(words.start) - shingle + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(shingle):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    value, at = _least(_mix(rolled), window - shingle + 1)
    return where, value[where], at[where]


def held_words(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(owner, skipped, words): texts in sections, about TEXT_BYTES at once; a section's text and the number of its words before it.

    The sections of a text overlap by window - 1 words, so that each window is in exactly one.
    """
    owner, skipped, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        tail, before = b"", 0
        for section in sections(text, TEXT_BYTES):
            held.append(tail + b" " + section if tail else section)
            owner.append(i)
            skipped.append(before)
            size += len(held[-1])
            if len(section) < len(text):
                last = held[-1].split()
                before += max(0, len(last) - window + 1)
                tail = b" ".join(last[max(0, len(last) - window + 1) :])
            if size >= TEXT_BYTES:
                yield np.array(owner), np.array(skipped), Words(held)
                owner, skipped, held, size = [], [], [], 0
    if held:
        yield np.array(owner), np.array(skipped), Words(held)


def _cells(value: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cells of anchors in a row of the sketch."""
    return (_mix(value + np.uint64((row * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """Bits of a cell's number, from the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (size // CELL_TEXT).bit_length()))


class Sketch:
    """A count-min sketch of fixed width; only the cells met are held, as their numbers and counts."""

    def __init__(self, bits: int):
        self.bits, self.cells = bits, [[] for _ in range(ROWS)]
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        for row in range(ROWS):
            self.cells[row].append(np.unique(_cells(values, row, self.bits), return_counts=True))
        self.size += len(values)

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(row, block, cells and counts): 16 bits of a cell's place in its block, 16 of its count, which stays at 65535."""
        for row, found in enumerate(self.cells):
            if not found:
                continue
            cells, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.minimum(np.bincount(back, np.concatenate([n for _, n in found]), len(cells)), 65535).astype(np.uint32)
            packed = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint32) | counts << np.uint32(16)
            cuts = np.append(np.flatnonzero(np.diff(cells >> BLOCK_BITS, prepend=-1)), len(cells))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield row, int(cells[lo] >> BLOCK_BITS), packed[lo:hi].tobytes()
        self.cells, self.size = [[] for _ in range(ROWS)], 0


def sketch(docs: DataFrame, bits: int, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(row, block, cells): the merged sketch, whose cells are counts of 16 bits, in blocks of 2**BLOCK_BITS; blocks without a count are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits)

        def emit() -> pa.RecordBatch:
            rows = list(own.blocks())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["row", "block", "cells"])

        for piece in pieces(batches, limit=TEXT_BYTES):
            for _, _, words in held_words(raw(piece), window):
                _, value, at = anchors(words, window, shingle)
                if len(at):
                    own.add(value[np.concatenate([[True], np.diff(at) != 0])])
                if own.size >= 1 << 21:
                    yield emit()
        yield emit()

    def add(state: np.ndarray | None, data: bytes) -> np.ndarray:
        state = np.zeros(1 << BLOCK_BITS, np.uint32) if state is None else state
        packed = np.frombuffer(data, np.uint32)
        state[packed & np.uint32(0xFFFF)] += packed >> np.uint32(16)
        return np.minimum(state, 65535, out=state)

    each = docs.select("text").mapInArrow(run, "row int, block int, cells binary")
    return fold_by_key(each, ["row", "block"], "cells", add, lambda state: zlib.compress(state.astype(np.uint16).tobytes(), 1))


class Estimate:
    """What is kept of a merged sketch: of each row the cells that count two or more, and a bitmap of heavy ones."""

    def __init__(self, merged: DataFrame, bits: int, heavy: int):
        """merged: a checkpoint of sketch(). Its blocks are folded to bits before they reach the driver."""
        self.bits, self.heavy_bits = bits, min(bits, HEAVY_BITS)
        self.twice = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
        self.heavy = np.zeros(1 << (self.heavy_bits - 3), np.uint8)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.frombuffer(zlib.decompress(x), np.uint16) for x in batch.column("cells").to_pylist()]
                planes = [[zlib.compress(np.packbits(x >= n, bitorder="little").tobytes(), 1) if (x >= n).any() else None for x in found] for n in (2, heavy)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("block"), *(pa.array(p, pa.binary()) for p in planes)], names=["row", "block", "twice", "heavy"])

        step = 1 << (BLOCK_BITS - 3)
        for r in merged.mapInArrow(fold, "row int, block int, twice binary, heavy binary").where("twice is not null").toLocalIterator():
            at = r["block"] * step
            self.twice[r["row"], at : at + step] = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
            if r["heavy"] is not None and r["row"] == 0:
                at %= len(self.heavy)
                self.heavy[at : at + step] |= np.frombuffer(zlib.decompress(bytes(r["heavy"])), np.uint8)

    def repeated(self, value: np.ndarray) -> np.ndarray:
        out = np.ones(len(value), bool)
        for row in range(ROWS):
            out &= _has(self.twice[row], _cells(value, row, self.bits))
        return out

    def common(self, value: np.ndarray) -> np.ndarray:
        return _has(self.heavy, _cells(value, 0, self.bits))


def _settle(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of these windows also start earlier among them. Equal anchor and digest mean equal words."""
    order = np.lexsort((start, doc, digest, anchor))
    a, g, d, s = anchor[order], digest[order], doc[order], start[order]
    first = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(g) != 0)]) if len(order) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = np.empty(len(order), bool)
    later[order] = (d != d[head]) | (s != s[head])
    return later


def _runs(*same: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs in which same stay equal and start goes up by one."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.diff(start) != 1
    for x in same:
        new |= np.diff(x) != 0
    at = np.concatenate([[0], np.flatnonzero(new) + 1])
    return at, np.diff(np.append(at, len(start)))


_FOUND = "anchor long, _key long, _version long, start long, n long, digests binary"


def _rows(anchor: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray, n: np.ndarray, digests: np.ndarray) -> pa.RecordBatch:
    """Rows of _FOUND; digests has n 64-bit values for each row, or none at all."""
    offsets = 8 * np.concatenate([[0], np.cumsum(n)]) if len(digests) else np.zeros(len(n) + 1, np.int64)
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(digests))])
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (anchor, doc, version, start, n)), packed], names=["anchor", "_key", "_version", "start", "n", "digests"])


def _spans(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Removed windows as rows without digests; their anchor only spreads them over the tasks."""
    order = np.lexsort((start, version, doc))
    doc, version, start = doc[order], version[order], start[order]
    at, n = _runs(doc, version, start=start)
    spread = _mix(doc[at].astype(np.uint64) * np.uint64(31) + start[at].astype(np.uint64)).view(np.int64)
    return _rows(spread, doc[at], version[at], start[at], n, np.empty(0, np.int64))


def _has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    cells = cells & (8 * len(bits) - 1)
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def repeated_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """Windows that also start earlier, as runs of neighbours: (_key, _version, start, n), computed. docs: (_key, _version, text).

    Between the tasks go the windows that are their task's first, as runs that share
    one anchor: the anchor's value and a 64-bit digest of each window's words. A window
    of a heavy anchor goes alone, under a value mixed from its anchor and its digest.
    """
    bits = sketch_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Estimate(checkpointed(sketch(docs, bits, window, shingle)), bits, heavy))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimated, digest = shared.value, xxhash.xxh3_64_digest
        for piece in pieces(batches, limit=TEXT_BYTES):
            keys, versions = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_version"))
            for owner, skipped, words in held_words(raw(piece), window):
                where, value, at = anchors(words, window, shingle)
                known = estimated.repeated(value)
                where, value, at = where[known], value[known], at[known]
                buffer = words.buffer
                hashed = b"".join([digest(buffer[a:b]) for a, b in zip(words.start[where].tolist(), words.end[where + window - 1].tolist(), strict=True)])
                digests, text = np.frombuffer(hashed, np.int64), words.text[where]
                hot = estimated.common(value)
                value[hot] = _mix(value[hot] ^ digests[hot].view(np.uint64) * np.uint64(_BASE))
                value = value.view(np.int64)
                doc, version = keys[owner[text]], versions[owner[text]]
                start = where - words.first[text] + skipped[text]
                later = _settle(value, digests, doc, version, start)
                yield _spans(doc[later], version[later], start[later])
                value, digests, doc, version, start, at, text = (x[~later] for x in (value, digests, doc, version, start, at, text))
                first, n = _runs(at, value, text, start=start)
                if len(first):
                    yield _rows(value[first], doc[first], version[first], start[first], n, digests)

    found = docs.select("_key", "_version", "text").mapInArrow(estimate, _FOUND)
    grouped = found.repartition("anchor").sortWithinPartitions("anchor")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            settled = pc.equal(pc.binary_length(batch.column("digests")), 0)
            yield batch.filter(settled)
            table = pa.Table.from_batches([batch.filter(pc.invert(settled))])
            held = table if held is None else pa.concat_tables([held, table])
            change = np.flatnonzero(np.diff(held.column("anchor").to_numpy()))
            if len(change):
                yield compare(held.slice(0, int(change[-1]) + 1))[0]
                held = held.slice(int(change[-1]) + 1)
            if held.num_rows > GROUP_ROWS:
                found, first = compare(held)
                yield found
                held = pa.Table.from_batches([first])
        if held is not None and held.num_rows:
            yield compare(held)[0]

    def compare(rows: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The windows of rows that also start earlier among them, and the first ones, each a row of its own."""
        n = rows.column("n").to_numpy()
        anchor, doc, version, start = (np.repeat(rows.column(c).to_numpy(), n) for c in ("anchor", "_key", "_version", "start"))
        start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
        digests = np.frombuffer(b"".join(rows.column("digests").to_pylist()), np.int64)
        later = _settle(anchor, digests, doc, version, start)
        first = ~later
        return _spans(doc[later], version[later], start[later]), _rows(anchor[first], doc[first], version[first], start[first], np.ones(first.sum(), np.int64), digests[first])

    out = checkpointed(grouped.mapInArrow(exact, _FOUND).select("_key", "_version", "start", "n"))
    shared.destroy()
    return out


def _marked(by_text: DataFrame, key: str, version: str) -> Column:
    """Whether a row may be one of by_text: by a broadcast bitmap of MARK_BITS bits or more for each row of it, up to 2**MAX_BITS."""
    size = 1 << min(MAX_BITS, max(MIN_BITS, (by_text.count() * MARK_BITS).bit_length()))
    slot = F.pmod(F.xxhash64(key, version), F.lit(size)).cast("int")
    bits = np.zeros(size >> 3, np.uint8)
    for batch in by_text.select(slot.alias("slot")).toArrow().to_batches():
        at = batch.column("slot").to_numpy()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    shared = by_text.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def has(slots: pa.Array) -> pa.Array:
        return pa.array(_has(shared.value, slots.to_numpy()))

    return has(slot)


def _covered(spans: list[dict], window: int) -> Iterator[bool]:
    """For each word of a text in turn whether it stays; without end."""
    at = 0
    for a, b in sorted((s["start"], s["start"] + s["n"] + window - 1) for s in spans):
        if b > at:
            yield from repeat(True, max(0, a - at))
            yield from repeat(False, b - max(a, at))
            at = b
    yield from repeat(True)


def drop_repeats(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """docs with text replaced by its kept words joined by single spaces, and _n_words, _n_removed, _kept_sha256.

    A text without a removed word keeps its exact form as text; _kept_sha256 is always that
    of its words joined by single spaces. doc_id must be an integer; a null one comes before
    all others. A null text has no words and stays null. Rows that repeat a document id are
    the same document: a window is earlier in one of them only by its place. Input columns
    of the three names are replaced; further columns pass through. An empty table gives an empty one. Only texts
    with spans (and about one of 16 others at most) are shuffled to be joined with them; the rest stay where they are read.
    """
    docs = docs.drop("_n_words", "_n_removed", "_kept_sha256")
    key, version, held = (free_name(x, docs.columns) for x in ("_key", "_version", "_spans"))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), version: F.xxhash64("text")})
    spans = repeated_spans(keyed.select(F.col(key).alias("_key"), F.col(version).alias("_version"), "text"), window, shingle, heavy)
    by_text = checkpointed(spans.groupBy(F.col("_key").alias(key), F.col("_version").alias(version)).agg(F.collect_list(F.struct("start", "n")).alias(held)))
    marked = _marked(by_text, key, version)
    joined = keyed.where(marked).join(by_text, [key, version], "left").unionByName(keyed.where(~marked).withColumn(held, F.lit(None).cast(by_text.schema[held].dataType))).drop(key, version)
    names = docs.columns
    schema = joined.drop(held).schema.add("_n_words", "long").add("_n_removed", "long").add("_kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            total, removed, digests, kept = [], [], [], []
            for data, text, spans in zip(raw(piece), piece.column("text").to_pylist(), piece.column(held).to_pylist(), strict=True):
                n_words, n_kept, digest, parts = 0, 0, hashlib.sha256(), []
                covered = _covered(spans, window) if spans else None
                for section in sections(data):
                    words = section.split()
                    n_words += len(words)
                    if covered is not None:
                        words = list(compress(words, islice(covered, len(words))))
                    if words:
                        joined = b" ".join(words)
                        digest.update(b" " + joined if n_kept else joined)
                        n_kept += len(words)
                        if covered is not None:
                            parts.append(joined)
                total.append(n_words)
                removed.append(n_words - n_kept)
                digests.append(digest.hexdigest())
                kept.append(text if covered is None else b" ".join(parts).decode("utf-8"))
            columns = [pa.array(kept, pa.string()) if c == "text" else piece.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[*names, "_n_words", "_n_removed", "_kept_sha256"])

    return joined.mapInArrow(run, schema)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))
