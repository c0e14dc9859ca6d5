"""Packing of documents' tokens into training sequences.

Each document is tokenised and ended by a separator id. Its full sequences are
cut off first; the remainders are packed by first-fit decreasing, where a
tournament tree over the bins' free capacities finds the first bin that fits in
logarithmic time. Documents are dealt at random (by a hash of their id and place) to groups
of about GROUP_DOCS, and each group is packed on its own, so a task's work and
memory don't grow with the input. Only lengths and checksums are shuffled.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, table, texts

#: Tokens of a sequence, the id that ends a document, documents of a group, segments whose ids a worker keeps.
SEQUENCE, SEPARATOR, GROUP_DOCS, KEPT_SEGMENTS = 1024, 0, 8192, 250_000
#: Characters below this one are letters, digits, signs and spaces that both libraries class alike.
LATIN_END = "\u0180"

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Bins of equal capacity, all empty at first; place() takes the leftmost bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items are taken by falling size, ties in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    filled: dict[int, int] = {}
    for i in order.tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, offsets


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's splitting rule never lets a match run over a single space
    between two characters that are not white space, so such a text is the
    concatenation of its segments, each with the space before it; their ids are
    kept. A text with any other use of spaces, or with a special token's string,
    goes to the library as a whole. With ranks, a file of the same vocabulary as
    merge ranks, segments of Latin letters, digits and signs are encoded by the
    faster library that reads it; both give the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None, kept: int = KEPT_SEGMENTS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept = kept
        self.ids: dict[str, bytes] = {}
        self.ranked = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def _compile(self, segments: list[str]) -> None:
        """Keeps the ids of segments, each with a space before it."""
        rest = segments
        if self.ranked:
            rest, ranked, ids = [], self.ranked, self.ids
            for p in segments:
                if max(p) < LATIN_END:
                    found = ranked(" " + p)
                    ids[p] = struct.pack(f"<{len(found)}I", *found)
                else:
                    rest.append(p)
        for at in range(0, len(rest), 4096):
            block = rest[at : at + 4096]
            self.ids.update(zip(block, self._encode([" " + p for p in block]), strict=True))

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _regular(self, segment: str) -> bool:
        return bool(segment) and not segment[0].isspace() and not segment[-1].isspace()

    def encode(self, docs: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        new: dict[str, None] = {}
        if len(self.ids) > self.kept:
            self.ids = {}
        for text in docs:
            if not text or any(s in text for s in self.special):
                split.append(None)
                continue
            parts = text.split(" ")
            fresh = [p for p in parts[1:] if p not in self.ids and p not in new]
            if not self._regular(parts[0]) or not all(map(self._regular, fresh)):
                split.append(None)
                continue
            new.update(dict.fromkeys(fresh))
            split.append(parts)
        self._compile(list(new))
        heads = iter(self._encode([p[0] for p in split if p is not None]))
        whole = iter(self._encode([t for t, p in zip(docs, split, strict=True) if p is None]))
        return [next(whole) if p is None else next(heads) + b"".join(map(self.ids.__getitem__, p[1:])) for p in split]


@lru_cache(maxsize=4)
def byte_bpe(path: str, ranks: str | None) -> ByteBpe:
    return ByteBpe(path, ranks)


def tokenised(docs: DataFrame, path: str, ranks: str | None = None, sequence: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, doc_tokens, crcs): tokens of each document with its separator, and a CRC-32 for each piece of at most sequence tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = byte_bpe(path, ranks), np.array([separator], "<u4").tobytes(), 4 * sequence
        for piece in pieces(batches):
            ids = [x + end for x in bpe.encode(texts(piece))]
            crcs = [[zlib.crc32(x[at : at + step]) for at in range(0, len(x), step)] for x in ids]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "crcs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, path: str, ranks: str | None = None, sequence: int = SEQUENCE, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null text is empty and gives one piece, the separator. Repeated rows are
    packed each on their own. Further columns are ignored; an empty table gives
    an empty one. sequence_id is unique over all groups: the group's number times
    2**32 plus the sequence's number within it.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_tokens", "doc_id"], ignore_index=True)
        tokens = pdf["doc_tokens"].to_numpy()
        n_pieces = -(-tokens // sequence)
        row = np.repeat(np.arange(len(pdf)), n_pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = number * sequence
        length = np.minimum(sequence, tokens[row] - start)
        full = length == sequence
        at, offset = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        at[full] = np.arange(full.sum())
        bins, offset[~full] = first_fit_decreasing(length[~full], sequence)
        at[~full] = bins + full.sum()
        crcs = np.concatenate(pdf["crcs"].to_numpy())
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "start": start, "length": length, "ids_crc32": crcs, "doc_tokens": tokens[row], "sequence_id": (int(key[0]) << 32) + at, "offset": offset})

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = tokenised(docs, path, ranks, sequence, separator).withColumn("_group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, f"doc_id {kind}, {PIECES}")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
