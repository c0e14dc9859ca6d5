"""Scoring texts by online logistic context mixing over hashed contexts.

A text is read as its tokens: words, lower-cased in A-Z, joined by one space and ended by a
newline; a long text in parts, one after another. Each byte is predicted bit by bit. A predictor looks up, for its context and the bits of
the byte so far, how often a 0 and a 1 followed in the training texts; contexts are the last 1,
3, 4 and 5 bytes and the part of the current word so far (from its last multiple of CHUNK bytes), each hashed into a table whose
size follows the number of distinct contexts, up to 2**MAX_BITS slots. The
predictors' log-odds are added with weights that are gated by how much the two longest contexts
know, and the sum is refined by an adaptive map from (bits so far, log-odds) to probability.
Weights and map are learned online over all training texts, in the order in which a task reads
them, each byte's own occurrence left out of its counts: all eight bit decisions of every byte. Equal contexts and bytes of a task are tallied; as many as
a tally holds are evaluated once and count as often as they are met. A step is one of Newton's with all the curvature met so far, so that what the tasks have learned adds up: the sums of
curvature and of curvature times weights, and the map's sums, are merged over the tasks.
The counts come from all training texts: from distinct
6-byte sequences and words, which are aggregated before they are folded into the tables, block
by block. Scoring uses the model as learned, so that a score doesn't depend on other texts.

The base score adds smoothed unigram log-probabilities. The most frequent HEAD tokens are broadcast
with their counts; other tokens are joined by hash, where no value is heavy.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import PIECE_BYTES, fold_by_key, pieces, raw, sections, table
from tessera.session import checkpointed

#: Predictors: contexts of 1, 3, 4, 5 bytes, and the word so far.
WORD = 0
ORDERS = (1, 3, 4, 5, WORD)
#: Bits of the tables of 1 and 3 bytes, and of the others at least and at most (4 bytes: one less); slots for each distinct 6-byte sequence and word.
SMALL_BITS, LEAST_BITS, MAX_BITS, GRAM_SLOTS, WORD_SLOTS = {1: 16, 3: 20}, 17, 23, 8, 32
#: Frequent tokens that are broadcast, and bytes from which one goes as its hash; cached evaluations of a worker (bits), and how many codes are looked up at once.
HEAD, HEAD_BYTES, CACHE_BITS, AT_ONCE = 65_536, 1024, 22, 1 << 17
#: Classes of counts for each doubling, by which the frequent tokens are found.
CLASSES = 64
#: Bytes of a part of a text; bytes of text whose codes a task holds at once, and of those for which they are made at once (about 60 bytes of arrays for each, small enough for a processor's cache).
CHUNK, POSITION_BYTES, PART_BYTES = 1 << 16, 1 << 19, 1 << 16
#: Slots of a tally (bits), and the bytes of words, with their places, that a task counts at once.
TALLY_BITS, TOKEN_BYTES = 21, 1 << 24
#: Distinct sequences, and bytes of distinct words, that a task folds into tables.
FOLD_ROWS, FOLD_BYTES = 1 << 21, 1 << 24
#: The token that ends a text (no word holds white space), and the bytes of context before a text.
END, GRAM = b"\n", 6
_BLOCK_BITS = 14
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_AB = np.uint64(0x9E3779B97F4A7C15 * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes for each bit decision that is learned: all eight of every byte. Points of the scoring table for each unit of log-odds, up to 16 on both sides.
EVERY, POINTS = 1 / 8, 32
#: Different bytes learned from in the first step (later steps are larger, one of STEP_SHARE of those before, up to MAX_STEP), the prior's curvature and a bit's at least, and the weight of a point of the map before it is learned.
STEP, MAX_STEP, STEP_SHARE, PRIOR, LEAST_CURVE, MAP_PRIOR = 1024, 16_384, 32, 50.0, 0.02, 20.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power 0 to n - 1; the longest so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def canonical(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


Part = tuple[bytes, bytes]


def parts(text: bytes) -> Iterator[Part]:
    """The text as it is read, in parts of at most CHUNK bytes, each after the GRAM - 1 bytes before it.

    A part ends after a word, or at a multiple of CHUNK bytes within a longer one.
    """
    head, held = END * (GRAM - 1), b""
    for section in sections(text, CHUNK):
        joined = b" ".join(section.lower().split())
        if not joined:
            continue
        for part in _cut(held):
            yield head, part
            head = (head + part)[1 - GRAM :]
        held = joined + b" "
    for part in _cut(held[:-1] + END):
        yield head, part
        head = (head + part)[1 - GRAM :]


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind(b" ", at, at + CHUNK) + 1 or at + CHUNK
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def held_parts(texts: Iterable[bytes], limit: int) -> Iterator[tuple[np.ndarray, list[Part]]]:
    """The parts of texts, about limit bytes at once, with the number of each part's text."""
    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in parts(text):
            owner.append(i)
            held.append(part)
            size += len(part[1])
            if size >= limit:
                yield np.array(owner), held
                owner, held, size = [], [], 0
    if held:
        yield np.array(owner), held


def codes(docs: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of the parts: its 6-byte code and its part's number; with the bytes with heads and their places."""
    joined = np.frombuffer(b"".join(x for part in docs for x in part), np.uint8)
    sizes = np.fromiter((len(x) for _, x in docs), np.int64, len(docs))
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    at = np.arange(int(sizes.sum())) + (doc.astype(np.int64) + 1) * (GRAM - 1)
    # eight bytes from each place, the first one highest; the last GRAM - 1 places begin no code
    eight = np.ndarray(max(0, len(joined) - GRAM + 1), ">u8", joined.tobytes() + b"\0\0", strides=(1,))
    return (eight.astype(np.uint64) >> np.uint64(64 - 8 * GRAM))[at - (GRAM - 1)], doc, joined, at


def positions(docs: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of the parts: its 6-byte code, the hash of the word before it in the same part, and its part's number."""
    code, doc, joined, at = codes(docs)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(joined)))])
    gap = (joined == 32) | (joined == 10)
    gap[at[np.diff(doc, prepend=-1) != 0] - 1] = True  # a part starts a word, or goes on in one that is too long
    start = np.maximum.accumulate(np.where(gap, np.arange(len(joined)) + 1, 0))
    start = np.concatenate([[0], start[:-1]])[at]  # where the word that this byte continues began
    return code, _mix((total[at] - total[start]) * _powers(_INVERSE, len(joined) + 1)[start]), doc


def _contexts(code: np.ndarray, word: np.ndarray | None) -> dict[int, np.ndarray]:
    """Hashed context of each predictor."""
    out = {o: _mix(((code >> np.uint64(8)) & np.uint64((1 << 8 * o) - 1)) * _A + np.uint64(o)) for o in ORDERS if o != WORD}
    return out if word is None else out | {WORD: word}


def _pair(code: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """A hash of code, or of code and word; never zero."""
    return np.maximum(_mix(code * _A if word is None else code * _A + word), np.uint64(1))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the number of its value, in the order in which values are first met, and where each value is met first."""
    index = pa.array(keys).dictionary_encode().indices.to_numpy()
    return index, np.flatnonzero(np.diff(np.maximum.accumulate(index), prepend=-1))


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different codes, or pairs of code and word, in the order in which they are first met, and how often each occurs."""
    index, first = _numbered(_pair(*columns))
    return *(c[first] for c in columns), np.bincount(index)


class Tally:
    """How often each key occurs, with the key's columns; keys are added until there are many, then taken.

    A key is held in the slot that its hash gives. Where another one holds it, its occurrences are put aside, and counted when they are taken.
    """

    def __init__(self, columns: int):
        self.keys, self.counts = np.zeros(1 << TALLY_BITS, np.uint64), np.zeros(1 << TALLY_BITS, np.int64)
        self.columns = [np.zeros(1 << TALLY_BITS, np.uint64) for _ in range(columns)]
        self.held, self.aside, self.size, self.beside = [], [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        for at in range(0, len(columns[0]), AT_ONCE):
            self._add([c[at : at + AT_ONCE] for c in columns])

    def _add(self, columns: list[np.ndarray]) -> None:
        key = _pair(*columns)
        slot = (key >> np.uint64(64 - TALLY_BITS)).astype(np.int64)
        found = self.keys[slot]
        free = np.flatnonzero(found == 0)
        if len(free):
            at = slot[free]
            self.counts[at[::-1]] = free[::-1]  # of several the first
            new = free[self.counts[at] == free]
            taken = slot[new]
            self.counts[taken], self.keys[taken] = 0, key[new]
            found[free] = self.keys[at]
            for kept, given in zip(self.columns, columns, strict=True):
                kept[taken] = given[new]
            self.held.append(taken)
            self.size += len(new)
        same = found == key
        np.add.at(self.counts, slot[same], 1)
        if not same.all():
            self.aside.append([c[~same] for c in columns])
            self.beside += len(self.aside[-1][0])

    def full(self) -> bool:
        return self.size >= 1 << (TALLY_BITS - 1) or self.beside >= 1 << (TALLY_BITS - 1)

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The keys' columns, about in the order in which they are first met, and how often each occurs; none is held after that."""
        held = np.concatenate([np.empty(0, np.int64), *self.held])
        columns, counts = [c[held] for c in self.columns], self.counts[held]
        if self.aside:
            rest = [np.concatenate(c) for c in zip(*self.aside, strict=True)]
            *rest, times = _distinct(*rest)
            columns, counts = [np.concatenate(c) for c in zip(columns, rest, strict=True)], np.concatenate([counts, times])
        self.keys[held], self.counts[held] = 0, 0
        self.held, self.aside, self.size, self.beside = [], [], 0, 0
        return columns, counts


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return (((context + node.astype(np.uint64) * _A) * _B) >> np.uint64(64 - bits)).astype(np.int64)


class Fold:
    """Counts of 0 and 1 of each slot of a predictor's table, added up from (context, byte, times)."""

    def __init__(self, order: int, bits: int):
        self.order, self.bits = order, bits
        self.counts = np.zeros((2, 1 << self.bits), np.uint32)

    def add(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        symbol, n, flat = symbol.astype(np.int64), n.astype(np.uint32), self.counts.reshape(-1)
        for b in range(7, -1, -1):
            slot, bit = _slot(context, (1 << (7 - b)) | (symbol >> (b + 1)), self.bits), (symbol >> b) & 1
            np.add.at(flat, slot | bit << self.bits, n)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for at in range(0, 1 << self.bits, 1 << _BLOCK_BITS):
            block = self.counts[:, at : at + (1 << _BLOCK_BITS)]
            if block.any():
                yield at >> _BLOCK_BITS, zlib.compress(np.ascontiguousarray(block).tobytes(), 1)


_BLOCKS = "predictor int, block int, counts binary"


def _batch(folds: list[Fold]) -> pa.RecordBatch:
    rows = [(f.order, k, c) for f in folds for k, c in f.blocks()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["predictor", "block", "counts"])


def _many(some: Iterable[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The arrays of some put together, until there are about POSITION_BYTES of them."""
    held, size = [], 0
    for x in some:
        held.append(x)
        size += len(x[0])
        if size >= POSITION_BYTES:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): distinct 6-byte codes of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1)

        def taken() -> Iterator[pa.RecordBatch]:
            (gram,), n = tally.take()
            for at in range(0, len(gram), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(gram[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)], pa.int64())], names=["gram", "n"])

        for code in _many(codes(held)[:1] for piece in pieces(batches, limit=POSITION_BYTES) for _, held in held_parts(raw(piece), PART_BYTES)):
            tally.add(*code)
            if tally.full():
                yield from taken()
        yield from taken()

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def words_of(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The lower-cased words of about PIECE_BYTES of texts at once, each with the number of its text; a longer text goes in sections."""

    def put() -> tuple[np.ndarray, pa.Array]:
        _, ends, data = pa.array(held, pa.binary()).buffers()
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(held), ends, data))
        words = split.flatten().cast(pa.binary())
        own, filled = np.repeat(owner, split.value_lengths().to_numpy()), pc.binary_length(words).to_numpy() > 0
        return (own, words) if filled.all() else (own[filled], words.filter(pa.array(filled)))  # none is empty but those at a section's ends

    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        for section in sections(text):
            owner.append(i)
            held.append(section.lower())
            size += len(section)
            if size >= PIECE_BYTES:
                yield put()
                owner, held, size = [], [], 0
    if held:
        yield put()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token binary, n), each text's end among the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def taken() -> pa.RecordBatch:
            counted = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays(counted.flatten(), names=["token", "n"])

        for piece in pieces(batches):
            text = raw(piece)
            ends += len(text)
            for _, words in words_of(text):
                held.append(words)
                size += words.nbytes
                if size >= TOKEN_BYTES:
                    yield taken()
                    held, size = [], 0
        yield taken()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _bits(distinct: int, slots: int) -> int:
    return min(MAX_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, distinct * slots)))))


def tables(grams: DataFrame, tokens: DataFrame) -> dict[int, np.ndarray]:
    """Each predictor's counts as 16-bit numbers (a pair beyond is halved until it fits). grams and tokens are read several times."""
    n_grams = grams.count()
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("bytes")).first()
    bits = SMALL_BITS | {4: _bits(n_grams, GRAM_SLOTS) - 1, 5: _bits(n_grams, GRAM_SLOTS), WORD: _bits(size["n"], WORD_SLOTS)}

    def fold_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = [Fold(o, bits[o]) for o in ORDERS if o != WORD]
        for batch in batches:
            code, n = batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            context = _contexts(code, None)
            for f in folds:
                f.add(context[f.order], code & np.uint64(255), n)
        yield _batch(folds)

    def fold_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(WORD, bits[WORD])
        for piece in pieces(batches, "token", POSITION_BYTES):
            # a word is followed by a space; the end token by nothing, and it starts where a word would
            n, words = piece.column("n").to_numpy(), piece.column("token").to_pylist()
            for at in range(len(words)):
                words[at] = [(END * (GRAM - 1), x) for x in ([END] if words[at] == END else _cut(words[at] + b" "))]
            code, context, part = positions([x for w in words for x in w])
            fold.add(context, code & np.uint64(255), np.repeat(n, list(map(len, words)))[part])
        yield _batch([fold])

    def add(state: np.ndarray | None, data: bytes) -> np.ndarray:
        block = np.frombuffer(zlib.decompress(data), np.uint32)
        return block.astype(np.int64) if state is None else state + block

    def finish(state: np.ndarray) -> bytes:
        total = state.reshape(2, -1)
        while (big := total.max(axis=0) > 65535).any():
            total[:, big] = (total[:, big] + 1) >> 1
        return zlib.compress(total.astype(np.uint16).tobytes(), 1)

    # Sums don't depend on who adds them: rows are dealt evenly, by no key.
    folded = grams.repartition(max(1, -(-n_grams // FOLD_ROWS))).mapInArrow(fold_grams, _BLOCKS)
    folded = folded.union(tokens.repartition(max(1, -(-(size["bytes"] or 0) // FOLD_BYTES))).mapInArrow(fold_tokens, _BLOCKS))
    out = {o: np.zeros((2, 1 << bits[o]), np.uint16) for o in ORDERS}
    for r in fold_by_key(folded, ["predictor", "block"], "counts", add, finish).toLocalIterator():
        at = r["block"] << _BLOCK_BITS
        out[r["predictor"]][:, at : at + (1 << _BLOCK_BITS)] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint16).reshape(2, -1)
    return out


#: Classes of what a context knows: none, 1, 2 or 3, ... occurrences; packed in KNOWN_BITS bits.
KNOWN_BITS = 3
_KNOWN = np.array([min(7, i.bit_length()) for i in range(65)])
_GATES = 1 << 2 * KNOWN_BITS
_INPUTS = len(ORDERS) + 1
_LOG = np.log(np.arange(65536) + 0.3).astype(np.float32)

#: Packed log-odds: SCALE steps to 1, above the bits of what a context knows.
SCALE = 500


def _pack(counts: np.ndarray) -> np.ndarray:
    """Of each slot's two counts: clipped log-odds and how much is known, as one 16-bit number."""
    out = np.empty(counts.shape[1], np.int16)
    for at in range(0, len(out), 1 << 18):
        zero, one = counts[:, at : at + (1 << 18)]
        odds = np.rint(np.clip(_LOG[one] - _LOG[zero], -8, 8) * SCALE).astype(np.int16)
        out[at : at + (1 << 18)] = (odds << KNOWN_BITS) + _KNOWN[np.minimum(np.minimum(zero, 64) + np.minimum(one, 64), 64)].astype(np.int16)
    return out


def _joint(counts: np.ndarray) -> np.ndarray:
    """Of each slot's two counts one 32-bit number, with the ones above, so that both are met in one place."""
    return counts if counts.ndim == 1 else counts[0] | counts[1].astype(np.uint32) << np.uint32(16)


_GRID = np.linspace(-8, 8, 33)


class Mixer:
    """Gated weights and adaptive map, as a prior and what has been learned beyond it, in sums that add up over tasks.

    bits and packed: the predictors' tables, one number a slot.
    """

    def __init__(self, bits: dict[int, int], packed: dict[int, np.ndarray] | None = None):
        self.bits, self.packed, self.name, self.learned = bits, packed, uuid.uuid4().hex, 0
        self.curvature = np.zeros((8, _GATES, _INPUTS, _INPUTS))
        self.pull = np.zeros((8, _GATES, _INPUTS))
        self.seen = np.zeros((2, 256, len(_GRID)))  # weight of bits and of ones at the map's points
        self.settle()

    def settle(self) -> None:
        """Weights and map from the sums."""
        start = np.append(np.full(_INPUTS - 1, 0.35), 0)
        self.weights = np.linalg.solve(self.curvature + PRIOR * np.eye(_INPUTS), (self.pull + PRIOR * start)[..., None])[..., 0]
        prior = 1 / (1 + np.exp(-_GRID))
        self.map = np.clip((self.seen[1] + MAP_PRIOR * prior) / (self.seen[0] + MAP_PRIOR), 1e-5, 1 - 1e-5)
        self.scoring: tuple[np.ndarray, np.ndarray] | None = None

    def sums(self) -> Iterator[tuple[int, bytes]]:
        """What has been learned, by cell."""
        for b in range(8):
            for g in range(_GATES):
                if self.curvature[b, g].any():
                    yield b * _GATES + g, np.concatenate([self.curvature[b, g].ravel(), self.pull[b, g]]).tobytes()
        for node in range(256):
            if self.seen[0, node].any():
                yield 8 * _GATES + node, self.seen[:, node].tobytes()

    def put(self, cell: int, data: bytes) -> None:
        values = np.frombuffer(data)
        if cell < 8 * _GATES:
            b, g = divmod(cell, _GATES)
            self.curvature[b, g] = values[: _INPUTS**2].reshape(_INPUTS, _INPUTS)
            self.pull[b, g] = values[_INPUTS**2 :]
        else:
            self.seen[:, cell - 8 * _GATES] = values.reshape(2, -1)

    @staticmethod
    def _place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The map's point below each log-odds, and how far it is to the next."""
        place = (np.clip(z, -7.999, 7.999) + 8) * 2
        low = place.astype(np.int64)
        return low, place - low

    def final(self) -> np.ndarray:
        """Probability of a 1 by bits so far and log-odds at POINTS for each unit: the mean of the mixer's and the map's."""
        z = np.arange(-16 * POINTS, 16 * POINTS) / POINTS
        low, share = self._place(z)
        mapped = self.map[:, low] * (1 - share) + self.map[:, low + 1] * share
        return np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * mapped, 1e-5, 1 - 1e-5).astype(np.float32)

    def inputs(self, counts: dict[int, np.ndarray], context: dict[int, np.ndarray], node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictors' log-odds and the gate; this occurrence of bit is left out of the counts."""
        return self._inputs({o: _joint(c) for o, c in counts.items()}, {o: c * _B for o, c in context.items()}, node, bit)

    def _inputs(self, counts: dict[int, np.ndarray], spread: dict[int, np.ndarray], node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """inputs() of joint counts and of contexts times _B, which all bits of a byte share."""
        x, gate = np.empty((_INPUTS, len(node)), np.float32), 0
        branch, own_at = node.astype(np.uint64) * _AB, bit.astype(np.uint32) << np.uint32(4)
        other_at = np.uint32(16) - own_at
        for k, o in enumerate(ORDERS):
            both = counts[o].take(((spread[o] + branch) >> np.uint64(64 - self.bits[o])).view(np.int64))  # as _slot() has it
            own, other = (both >> own_at) & np.uint32(65535), (both >> other_at) & np.uint32(65535)
            own -= own > 0
            np.divide(own.astype(np.float32) + np.float32(0.3), other.astype(np.float32) + np.float32(0.3), out=x[k])
            if o in (5, WORD):
                gate = (gate << KNOWN_BITS) + _KNOWN.take(np.minimum(own + other, 64))
        odds = np.log(x[:-1], out=x[:-1])
        np.clip(odds, -8, 8, out=odds)
        odds *= (2 * bit - 1).astype(np.float32)
        x[-1] = 0.3
        return x.T, gate

    def learn(self, counts: dict[int, np.ndarray], code: np.ndarray, word: np.ndarray, times: np.ndarray | None = None) -> None:
        """Learns all eight bit decisions of every byte; equal codes and words are one, as many times as they occur, in the order in which they are first met.

        times: how often each pair of code and word occurs, where that has been counted.
        """
        if times is None:
            code, word, times = _distinct(code, word)
        counts = {o: _joint(c) for o, c in counts.items()}
        at = 0
        while at < len(code):
            step = min(MAX_STEP, max(STEP, self.learned // STEP_SHARE))
            c, n = code[at : at + step], times[at : at + step]
            spread, symbol = {o: x * _B for o, x in _contexts(c, word[at : at + step]).items()}, (c & np.uint64(255)).astype(np.int64)
            for b in range(8):
                bit, node = (symbol >> b) & 1, (1 << (7 - b)) | (symbol >> (b + 1))
                self._step(7 - b, *self._inputs(counts, spread, node, bit), bit, node, n)
            at += step
            self.learned += len(c)

    def _step(self, b: int, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, node: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, gate, bit, node, n = x.T.take(order, axis=1).astype(np.float64), gate.take(order), bit.take(order), node.take(order), n.take(order)
        cuts = np.append(np.flatnonzero(np.diff(gate, prepend=-1)), len(order))
        met = gate[cuts[:-1]]
        z = np.einsum("kn,kn->n", x, np.repeat(self.weights[b, met].T, np.diff(cuts), axis=1))
        z = np.clip(z, -30, 30, out=z)
        p = 1 / (1 + np.exp(-z))
        # of each input its product with the curvature, and below them the error
        both = np.empty((_INPUTS + 1, len(order)))
        np.multiply(x, np.maximum(p * (1 - p), LEAST_CURVE) * n, out=both[:-1])
        np.multiply(bit - p, n, out=both[-1])
        sums = np.empty((len(met), _INPUTS + 1, _INPUTS))
        for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            np.dot(both[:, lo:hi], x[:, lo:hi].T, out=sums[k])
        self.curvature[b, met] += sums[:, :-1]
        full = self.curvature[b, met] + PRIOR * np.eye(_INPUTS)
        self.weights[b, met] += np.linalg.solve(full, sums[:, -1, :, None])[..., 0]
        self.pull[b, met] = (full @ self.weights[b, met][..., None])[..., 0] - PRIOR * np.append(np.full(_INPUTS - 1, 0.35), 0)
        low, share = self._place(z)
        points, first, last = len(_GRID), 1 << b, 2 << b  # the nodes of this bit
        cell = ((node - first) * points + low) * 2 + bit
        upper = n * share
        for at, weight in ((0, n - upper), (2, upper)):
            seen = np.bincount(cell + at, weight, first * points * 2).reshape(first, points, 2)
            self.seen[0, first:last] += seen[..., 0] + seen[..., 1]
            self.seen[1, first:last] += seen[..., 1]
        self.scoring = None

    def logs(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte."""
        if self.scoring is None:
            self.scoring = self._scoring()
        weights, final = self.scoring
        out, low_bits, span = np.empty(len(code)), (1 << KNOWN_BITS) - 1, 32 * POINTS
        for at in range(0, len(code), 1 << 14):
            c = code[at : at + (1 << 14)]
            symbol, total = (c & np.uint64(255)).astype(np.int64), np.ones(len(c))
            spread = {o: x * _B for o, x in _contexts(c, word[at : at + (1 << 14)]).items()}
            x = np.empty((_INPUTS, len(c)), np.float32)
            x[-1] = 1
            for b in range(7, -1, -1):
                bit, node = (symbol >> b) & 1, (1 << (7 - b)) | (symbol >> (b + 1))
                branch, gate = node.astype(np.uint64) * _AB, 0
                for k, o in enumerate(ORDERS):
                    v = self.packed[o].take(((spread[o] + branch) >> np.uint64(64 - self.bits[o])).view(np.int64))  # as _slot() has it
                    x[k] = v >> KNOWN_BITS
                    if o in (5, WORD):
                        gate = (gate << KNOWN_BITS) + (v & low_bits)
                z = np.einsum("kn,nk->n", x, weights[7 - b].take(gate, axis=0))
                place = np.clip(np.rint(z, out=z), -span // 2, span // 2 - 1).astype(np.int64)
                p = final.take(node * span + place + span // 2)
                total *= np.abs((1 - bit).astype(np.float32) - p)
            out[at : at + (1 << 14)] = np.log10(total)
        return out

    def _scoring(self) -> tuple[np.ndarray, np.ndarray]:
        """What logs() looks up: weights of packed log-odds, in POINTS, and the final probabilities."""
        weights = self.weights.astype(np.float32)
        weights[..., :-1] *= np.float32(POINTS / SCALE)
        weights[..., -1] *= np.float32(POINTS * 0.3)
        return weights, self.final().ravel()


class Cache:
    """Evaluations of (code, word) kept by a worker from task to task, in slots that newer ones overwrite."""

    kept: tuple[str, Cache] | None = None

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.slots = np.zeros(1 << CACHE_BITS, np.uint64)  # 32 bits of the key beyond the slot's number, 32 of the value

    @classmethod
    def of(cls, mixer: Mixer) -> Cache:
        """This worker's cache for the mixer; a former mixer's is given up."""
        if cls.kept is None or cls.kept[0] != mixer.name:
            cls.kept = None
            cls.kept = (mixer.name, cls(mixer))
        return cls.kept[1]

    def logs(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.empty(len(code))
        for at in range(0, len(code), AT_ONCE):
            out[at : at + AT_ONCE] = self._logs(code[at : at + AT_ONCE], word[at : at + AT_ONCE])
        return out

    def _logs(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = _pair(code, word) | np.uint64(1)
        slot, mark = (key >> np.uint64(64 - CACHE_BITS)).view(np.int64), key.astype(np.uint32)
        found = self.slots[slot]
        out = found.astype(np.uint32).view(np.float32)
        gone = np.flatnonzero((found >> np.uint64(32)).astype(np.uint32) != mark)
        if len(gone):
            index, first = _numbered(key[gone])
            new = gone[first]
            value = self.mixer.logs(code[new], word[new]).astype(np.float32)
            out[gone] = value[index]
            self.slots[slot[new]] = key[new] << np.uint64(32) | value.view(np.uint32)
        return out


def learn_texts(mixer: Mixer, counts: dict[int, np.ndarray], batches: Iterable[pa.RecordBatch]) -> None:
    """The mixer learns all texts of the batches, equal codes and words of as many texts as a tally holds at once."""
    tally = Tally(2)
    for pairs in _many(positions(held)[:2] for piece in pieces(batches, limit=POSITION_BYTES) for _, held in held_parts(raw(piece), PART_BYTES)):
        tally.add(*pairs)
        if tally.full():
            (code, word), times = tally.take()
            mixer.learn(counts, code, word, times)
    (code, word), times = tally.take()
    mixer.learn(counts, code, word, times)


def train(docs: DataFrame, tokens: DataFrame) -> Mixer:
    """The model of docs (text); tokens: their token_counts(), as a checkpoint."""
    counts = tables(checkpointed(gram_counts(docs)), tokens)
    bits = {o: x.shape[1].bit_length() - 1 for o, x in counts.items()}
    shared = docs.sparkSession.sparkContext.broadcast({o: _joint(x) for o, x in counts.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(bits)
        learn_texts(mixer, shared.value, batches)
        sums = list(mixer.sums())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sums], pa.int32()), pa.array([v for _, v in sums], pa.binary())], names=["cell", "learned"])

    add = lambda state, data: np.frombuffer(data) if state is None else state + np.frombuffer(data)
    learned = fold_by_key(docs.select("text").mapInArrow(run, "cell int, learned binary"), ["cell"], "learned", add, lambda state: state.tobytes(), ["learned"]).collect()
    shared.destroy()
    mixer = Mixer(bits, {o: _pack(x) for o, x in counts.items()})
    for r in learned:
        mixer.put(r["cell"], bytes(r["learned"]))
    mixer.settle()
    return mixer


def is_held_out() -> Column:
    """crc32 of the id as text modulo 5 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def frequent(tokens: DataFrame, head: int = HEAD) -> dict[bytes | int, int]:
    """Counts of the most frequent tokens, as many whole classes of about equal counts as hold no more than head.

    Only class sizes (at most 63 * CLASSES) and the chosen tokens reach the driver, whatever the
    number of partitions. A token of more than HEAD_BYTES bytes goes as its _key().
    """
    classes = tokens.groupBy(F.floor(F.log2("n") * CLASSES).alias("class")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).collect()
    taken, least = 0, None
    for c in sorted(classes, key=lambda r: -r["class"]):
        taken += c["size"]
        if taken > head:
            break
        least = c["least"]
    if least is None:
        return {}
    chosen = tokens.where(F.col("n") >= least).select(F.when(F.octet_length("token") <= HEAD_BYTES, F.col("token")).alias("token"), F.xxhash64("token").alias("key"), "n").toArrow()
    return {k if t is None else t: n for t, k, n in zip(*(chosen.column(c).to_pylist() for c in ("token", "key", "n")), strict=True)}


def _key(token: bytes) -> int:
    """As Spark's xxhash64 has it."""
    h = xxhash.xxh64_intdigest(token, 42)
    return h - (1 << 64) if h >> 63 else h


def base_scores(texts: list[bytes], logs: dict[bytes | int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of each text: its tokens, how many of them have one of the logs (all below zero) of the frequent() ones, the sum of these logs; the _key() of each other token, and how often it occurs."""
    size, end = len(texts), logs.get(END, 0.0)
    n, known, base = np.ones(size, np.int64), np.full(size, int(end < 0)), np.full(size, end)
    owners, keys, times = [], [], []
    if not end:
        owners, keys, times = [np.arange(size)], [np.full(size, _key(END))], [np.ones(size, np.int64)]
    for owner, words in words_of(texts):
        coded = words.dictionary_encode()
        index, tokens = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        log = np.fromiter(map(logs.get, tokens, repeat(0.0)), float, len(tokens))
        for k in np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() > HEAD_BYTES):
            log[k] = logs.get(_key(tokens[k]), 0.0)
        found = log[index]
        n += np.bincount(owner, minlength=size)
        known += np.bincount(owner[found < 0], minlength=size)
        base += np.bincount(owner, found, size)
        other = found == 0
        pair, count = np.unique(owner[other] * len(tokens) + index[other], return_counts=True)
        key = np.zeros(len(tokens), np.int64)
        rare = np.flatnonzero(log == 0)
        key[rare] = [_key(t) for t in tokens[rare]]
        if len(pair):
            owners.append(pair // len(tokens))
            keys.append(key[pair % len(tokens)])
            times.append(count)
    owner, key, count = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owners, keys, times))
    order = np.argsort(owner, kind="stable")
    starts = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=size))), pa.int32())
    return n, known, base, *(pa.ListArray.from_arrays(starts, pa.array(x[order])) for x in (key, count))


def score(docs: DataFrame, training: DataFrame, head: int = HEAD) -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    training (text) gives all counts. A null text is empty: its only token is the end. Repeated
    rows get equal values; further columns are ignored; an empty table gives an empty one. Without
    training texts all predictors are uninformed and train_tokens is 0. n_bytes are those of the text as it is read.
    """
    tokens = checkpointed(token_counts(training))
    totals = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, smooth = totals["n"] or 0, (totals["n"] or 0) + 0.5 * (totals["v"] + 1)
    known_logs = {t: float(np.log10((n + 0.5) / smooth)) for t, n in frequent(tokens, head).items()}
    shared = docs.sparkSession.sparkContext.broadcast((train(training, tokens), known_logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, logs = shared.value
        cache = Cache.of(mixer)
        for piece in pieces(batches, limit=POSITION_BYTES):
            text = raw(piece)
            total, size = np.zeros(len(text)), np.zeros(len(text), np.int64)
            for owner, held in held_parts(text, PART_BYTES):
                code, word, part = positions(held)
                total += np.bincount(owner[part], cache.logs(code, word), len(text))
                size += np.bincount(owner[part], minlength=len(text))
            n, known, base, rest, times = base_scores(text, logs)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(total), pa.array(size), rest, times],
                names=["doc_id", "n_tokens", "known", "base", "score", "n_bytes", "rest", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, score double, n_bytes long, rest array<long>, times array<long>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    rare = tokens.select(F.xxhash64("token").alias("key"), "n")
    each = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("row", F.col("e.rest").alias("key"), F.col("e.times").alias("times"))
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(smooth)))
    sums = each.join(rare, "key", "left").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, docs.where(~is_held_out())).select(
        "doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
