"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in
at most RADIUS bits agree on at least BLOCKS - RADIUS whole blocks, so each is sent
to one shard for every choice of that many blocks, and linked pairs always meet.
A shard holds a BK-tree of its distinct fingerprints: children are keyed by their
Hamming distance to the parent, and a search follows only the edges within the
radius. A shard's tree is built and searched where its rows are: only a tree of
bounded size is ever held by a task, and none is gathered on the driver. A shard
of more than TREE_ROWS fingerprints is dealt into parts by hash, and every pair of
parts is a shard of its own, so none is left out and none grows without bound.
A shard returns the links of a spanning forest, not all pairs.

A fingerprint of 64 bits finds near copies, not all texts of a given similarity (two sets of Jaccard similarity
0.8 differ in about 10 bits). Where links are defined by similarity, the trees' links are checked
exactly and completed by tessera.llm.jaccard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, raw, sections, table
from tessera.llm.components import connected_components
from tessera.session import checkpointed

#: Words of a shingle, differing bits of a link, blocks of a fingerprint, fingerprints of a shard's part.
WORDS, RADIUS, BLOCKS, TREE_ROWS = 4, 4, 6, 16_384
#: Copies from which a fingerprint is joined by a broadcast, and such fingerprints at most.
COPIES, HEAVY = 64, 10_000
#: Shards up to this size walk their tree one fingerprint at a time; larger ones in vectors.
SMALL = 32


#: Hashes whose bits a task counts at once.
COUNTED = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes, given as rows of 8 bytes from the highest; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[at : at + COUNTED], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words. A long text is read in sections."""
    counts, total, tail, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for section in sections(text):
        found = tail + section.lower().split()
        tail = found[max(0, len(found) - words + 1) :]
        if len(found) < words:
            continue
        total += _count(found, words, counts, digest)
    if not total:
        return majority(np.frombuffer(digest(b" ".join(tail), 42), np.uint8).reshape(1, 8)) if tail else 0
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _count(found: list[bytes], words: int, counts: np.ndarray, digest: Callable[[bytes, int], bytes]) -> int:
    """Adds the bits of the shingles of found to counts; their number."""
    n = len(found) - words + 1
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)])
    bits = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, COUNTED):
        counts += np.unpackbits(bits[at : at + COUNTED], axis=1).sum(axis=0, dtype=np.uint32)
    return n


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long). A null text has no words and so fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            fps = np.fromiter((fingerprint(x, words) for x in raw(piece)), np.uint64, piece.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class BkTree:
    """A BK-tree over distinct 64-bit fingerprints; search() walks it with many queries at once."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.children: list[list[tuple[int, int]]] = [[] for _ in fps]
        waiting = [np.arange(len(fps))] if len(fps) else []
        while waiting:
            members = waiting.pop()
            root, rest = int(members[0]), members[1:]
            if not len(rest):
                continue
            distance = np.bitwise_count(fps[rest] ^ fps[root])
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for group in np.split(rest[order], cuts):
                self.children[root].append((int(np.bitwise_count(fps[group[0]] ^ fps[root])), int(group[0])))
                waiting.append(group)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within radius of it), for the nodes that are reached."""
        waiting = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while waiting:
            node, who = waiting.pop()
            distance = np.bitwise_count(queries[who] ^ self.fps[node]).astype(np.int16)
            yield node, who[distance <= radius]
            for edge, child in self.children[node]:
                near = who[np.abs(distance - edge) <= radius]
                if len(near):
                    waiting.append((child, near))


def _small_forest(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links of a small shard: each fingerprint searches the tree of those before it, then joins it."""
    tree: list[dict[int, int]] = [{}]
    for i in range(1, len(fps)):
        x, waiting = fps[i], [0]
        while waiting:
            node = waiting.pop()
            d = (x ^ fps[node]).bit_count()
            if d <= radius:
                yield node, i
            waiting += [child for edge, child in tree[node].items() if -radius <= edge - d <= radius]
        node = 0
        while (d := (x ^ fps[node]).bit_count()) in tree[node]:
            node = tree[node][d]
        tree[node][d] = i
        tree.append({})


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of positions."""
    if len(fps) <= SMALL:
        yield from _small_forest(fps.tolist(), radius)
        return
    label = np.arange(len(fps))
    for node, hits in BkTree(fps).search(fps, radius):
        own = label[node]
        others, first = np.unique(label[hits], return_index=True)
        for other, at in zip(others.tolist(), first.tolist(), strict=True):
            if other != own:
                yield node, int(hits[at])
                label[label == other] = own


def _block_keys(fp: Column, radius: int, blocks: int) -> list[Column]:
    """A key for each choice of blocks - radius blocks, with the number of the choice on top."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    value = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return [F.xxhash64(F.lit(n), *[value[i] for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))]


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (src, dst) that connect the nodes (fp, node) within radius; fp must be distinct."""
    keyed = nodes.select("fp", "node", F.explode(F.array(*_block_keys(F.col("fp"), radius, blocks))).alias("block"))
    sizes = keyed.groupBy("block").count().where("count > 1").select("block", F.ceil(F.col("count") / tree_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("a"), F.greatest(j, F.col("part")).alias("b")))
    shards = (
        keyed.join(sizes, "block")
        .withColumn("part", part)
        .select("block", "fp", "node", F.explode(pairs).alias("pair"))
        .select("block", "pair.a", "pair.b", "fp", "node")
    )
    shards = shards.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "a", "b", "fp", "node")]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            block, a, b = columns[:3]
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            cut = int(change[-1]) if len(change) else 0
            held = [x[cut:] for x in columns]
            if cut:
                yield found(columns[3][:cut], columns[4][:cut], np.concatenate([[0], change]))
        if held is not None and len(held[0]):
            yield found(held[3], held[4], np.array([0, len(held[0])]))

    def found(fp: np.ndarray, node: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        src, dst, fp = [], [], fp.view(np.uint64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for i, j in _forest(fp[lo:hi], radius):
                src.append(node[lo + i])
                dst.append(node[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return shards.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: (doc_id, fp, component_id), component_id the least doc_id reachable over links.

    doc_id must be an integer. A null or wordless text has fingerprint 0, which
    links like any other; a null doc_id gives no component its name, and where a
    fingerprint has only such rows component_id is null. Repeated rows share a
    component. Further columns are ignored; an empty table gives an empty one.
    """
    prints = checkpointed(fingerprints(docs, words))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"), F.count(F.lit(1)).alias("size")))
    linked = connected_components(links(nodes.where("node is not null").select("fp", "node"), radius))
    classes = checkpointed(nodes.join(linked, "node", "left").select("fp", "size", F.coalesce("component", "node").alias("component_id")))
    # a fingerprint of very many copies would be one key of the join: those few are broadcast
    most = F.broadcast(classes.where(F.col("size") >= COPIES).orderBy(F.col("size").desc(), "fp").limit(HEAVY).select("fp", F.col("component_id").alias("heavy")))
    few = prints.join(most, "fp").select("doc_id", "fp", F.col("heavy").alias("component_id"))
    rest = prints.join(most, "fp", "left_anti").join(classes.select("fp", "component_id"), "fp")
    return few.union(rest.select("doc_id", "fp", "component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
