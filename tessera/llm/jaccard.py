"""Near-duplicates by SimHash where links are defined by exact Jaccard similarity of word shingles.

A text is the set of its distinct hashed WORDS-word shingles (ASCII lower case; a shorter text
is one shingle). Two sets are linked where their Jaccard similarity is SIMILAR or more. First come the links of
the BK-trees of tessera.llm.simhash, over fingerprints of the sets, each checked exactly. Fingerprints
miss many links at 0.8 to 0.95, so they are completed: all sets
are read in one total order of shingles, the common ones last. Linked sets then share a shingle
among the first n - ceil(SIMILAR * n) + 1 of each (n its size), so only sets that meet often enough in such
prefixes are compared, and none is missed: the order decides how many are compared, not which links
are found. Each set is compared with a few leaders of each of its groups; only sets that
are in different components after ROUNDS of that are compared pair by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tessera.llm.common import fold_by_key, pieces, raw
from tessera.llm.components import connected_components
from tessera.llm.simhash import RADIUS, links, majority
from tessera.llm.substring import Words, _mix
from tessera.session import checkpointed

#: Words of a shingle; a link's least similarity as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: One document of SAMPLE is read to find common shingles: COMMON times met or more in it, and the COMMONS most frequent at most.
SAMPLE, COMMON, COMMONS = 16, 2, 1 << 18
#: Bytes of text that a task hashes at once.
HASH_BYTES = 1 << 20
#: Bits of the bitmap of documents to compare, that decides which texts are hashed and shuffled again, and of a block of it.
BITS, BLOCK_BITS = 24, 16
#: Rounds in which each set is compared with leaders, and leaders of a shingle in each.
ROUNDS, LEADERS = 1, 4
#: Words of 64 bits in the bitmap of a set's open shingles.
LANES = 4
#: Words of 64 bits in the bitmap of a whole set.
MARKS = 16
#: Pairs of one leader that a task compares.
PART = 256
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, in order of value; none of a text without words."""
    found = Words([x.lower() for x in texts])
    h, n = found.hashes(), max(0, len(found.start) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled = rolled * _FACTOR + h[j : j + n]
    rolled = _mix(rolled)
    for first, count in zip(found.first.tolist(), found.count.tolist(), strict=True):
        if count >= words:
            yield np.unique(rolled[first : first + count - words + 1])
        else:
            yield np.array([xxhash.xxh64_intdigest(h[first : first + count].tobytes(), count)] if count else [], np.uint64)


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def common(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample of the documents, in order of value, and their counts. They only order the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=HASH_BYTES):
            value, n = np.unique(np.concatenate(list(sets(raw(piece), words))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLE)) == 0).select("text")
    counts = checkpointed(sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON))
    taken, least = 0, None
    for r in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("size")).collect(), key=lambda r: -r["n"]):
        taken += r["size"]
        if taken > COMMONS:
            break
        least = r["n"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counts.where(F.col("n") >= least).toArrow()
    value, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def _marks(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of a whole set, MARKS words of 64 bits."""
    out = np.zeros(MARKS, np.uint64)
    np.bitwise_or.at(out, ((shingles >> np.uint64(6)) % np.uint64(MARKS)).astype(np.int64), np.uint64(1) << (shingles & np.uint64(63)))
    return out


def marked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets (key, n, marks) may overlap enough: a shingle whose bit the other set lacks isn't shared."""
    of, over = SIMILAR
    own = lambda c, x: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}"))
    both = pairs.join(own("a", "a"), "a").join(own("b", "b"), "b")
    alone = lambda x, y: F.aggregate(F.zip_with(f"marks_{x}", f"marks_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    shared = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    return both.where(shared * (of + over) >= (F.col("n_a") + F.col("n_b")) * of).select(pairs.columns)


def prefixes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, version, key, n, fp, marks, prefix array<long>) per row of docs (doc_id, version, text), computed: equal sets have equal keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs, words))
    of, over = SIMILAR

    def prefix(x: np.ndarray) -> np.ndarray:
        values, counts = shared.value
        size = len(x) - (of * len(x) + over - 1) // over + 1 if len(x) else 0
        if not len(values):
            return x[:size]
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        return x[np.argsort(np.where(values[at] == x, counts[at], 0), kind="stable")[:size]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=HASH_BYTES):
            keys, sizes, prints, marks, firsts = [], [], [], [], []
            for x in sets(raw(piece), words):
                keys.append(_key(x))
                sizes.append(len(x))
                prints.append(majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)))
                marks.append(_marks(x).view(np.int64).tolist())
                firsts.append(prefix(x).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]), pa.int32()), pa.array(np.concatenate(firsts), pa.int64()))
            found = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(marks, pa.list_(pa.int64())), lists]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("version"), *found], names=["doc_id", "version", "key", "n", "fp", "marks", "prefix"])

    out = checkpointed(docs.mapInArrow(run, "doc_id long, version long, key long, n int, fp long, marks array<long>, prefix array<long>"))
    shared.destroy()
    return out


def bitmap(cells: DataFrame, bits: int = BITS) -> dict[int, np.ndarray]:
    """The blocks of a bitmap of 2**bits bits with cell modulo 2**bits set for each cell; only blocks with a bit are held."""
    block = min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(batch.column("cell").to_numpy())
            cuts = np.append(np.flatnonzero(np.diff(cell >> block, prepend=-1)), len(cell))
            parts = [cell[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0] >> block) for x in parts], pa.int64()), pa.array([(x & ((1 << block) - 1)).astype(np.uint32).tobytes() for x in parts], pa.binary())], names=["block", "cells"])

    def add(state: np.ndarray | None, data: bytes) -> np.ndarray:
        state = np.zeros(1 << block, bool) if state is None else state
        state[np.frombuffer(data, np.uint32)] = True
        return state

    each = cells.select(F.col("cell").bitwiseAND(F.lit((1 << bits) - 1)).alias("cell")).mapInArrow(run, "block long, cells binary")
    folded = fold_by_key(each, ["block"], "cells", add, lambda state: zlib.compress(np.packbits(state, bitorder="little").tobytes(), 1))
    return {r["block"]: np.frombuffer(zlib.decompress(bytes(r["cells"])), np.uint8) for r in folded.toLocalIterator()}


def _has(blocks: dict[int, np.ndarray], cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    block = min(bits, BLOCK_BITS)
    out = np.zeros(len(cells), bool)
    for number in np.unique(cells >> block).tolist():
        if number in blocks:
            mine = cells >> block == number
            low = cells[mine] & ((1 << block) - 1)
            out[mine] = blocks[number][low >> 3] >> (low & 7).astype(np.uint8) & 1 == 1
    return out


def _possible(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two sets that share the shingle at their place at (from 0) can be linked.

    Before that place they can share at most as many shingles as the one with fewer open ones has there.
    """
    of, over = SIMILAR
    most = F.least(a("before"), b("before")) + 1 + F.least(a("n") - a("at") - 1, b("n") - b("at") - 1)
    return (F.least(a("n"), b("n")) * over >= F.greatest(a("n"), b("n")) * of) & (most * (of + over) >= (a("n") + b("n")) * of)


def _first_shared(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the shingle may be the first one that two linked sets share: all that they must share lie from there on.

    Their open shingles must overlap enough, too: of a set's, those whose bit the other lacks aren't shared.
    """
    of, over = SIMILAR
    need = F.ceil((a("n") + b("n")) * of / (of + over))
    rest = F.greatest(F.ceil(a("n") * of / over), F.ceil(b("n") * of / over)) - 1
    alone = lambda p, q: sum((F.bit_count(p(f"bits{i}").bitwiseAND(F.bitwise_not(q(f"bits{i}")))) for i in range(LANES)), F.lit(0))
    both = F.least(a("open") - alone(a, b), b("open") - alone(b, a))
    return (a("at") <= a("n") - need) & (b("at") <= b("n") - need) & (both + rest >= need)


def _candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, a_id, b_id) of met (with sizes n, m, a row for each shared shingle of the prefixes) that can be linked.

    The set whose prefix ends first in the order shares with the other those shingles and at most its own rest.
    """
    of, over = SIMILAR
    rest = F.greatest(F.ceil(F.col("n") * of / over), F.ceil(F.col("m") * of / over)) - 1
    pairs = met.groupBy("a", "b", "a_id", "b_id", "n", "m").agg(F.count(F.lit(1)).alias("both"))
    return checkpointed(pairs.where((F.col("both") + rest) * (of + over) >= (F.col("n") + F.col("m")) * of).select("a", "b", "a_id", "b_id"))


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """Links (src, dst): those of pairs (a, b, a_id, b_id) whose sets are similar enough.

    A text goes to each pair's a, beside a's own; a's with more than PART pairs are dealt into parts.
    """
    of, over = SIMILAR
    low = F.lit((1 << BITS) - 1)
    wanted = pairs.select(F.explode(F.array("a_id", "b_id")).alias("id")).select(F.xxhash64("id").bitwiseAND(low).alias("cell"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, BITS))
    sizes = pairs.groupBy("a").agg(F.min("a_id").alias("id"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = pairs.join(sizes.select("a", "parts"), "a").select(F.col("b_id").alias("id"), F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    leaders = sizes.select("id", F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    # a document once, with all places that its text goes to
    places = members.union(leaders).groupBy("id", "key").agg(F.collect_list(F.struct("a", "part", "member")).alias("places"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_has(shared.value, batch.column("cell").to_numpy())))
            for piece in pieces([batch], limit=HASH_BYTES):
                found = raw(piece)
                keys = [_key(x) for x in sets(found, words)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(keys, pa.int64()), pa.array([zlib.compress(x, 1) for x in found], pa.binary())], names=["id", "key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, None
        for batch in batches:
            src, dst = [], []
            for a, part, member, key, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "member", "key", "packed")), strict=True):
                if not member:
                    if place != (a, part):
                        place, own = (a, part), next(sets([zlib.decompress(packed)], words))
                    continue
                x = next(sets([zlib.decompress(packed)], words))
                both = len(np.intersect1d(x, own, assume_unique=True))
                if place == (a, part) and both * (of + over) >= (len(x) + len(own)) * of:
                    src.append(a)
                    dst.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    each = docs.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(low).alias("cell")).mapInArrow(chosen, "id long, key long, packed binary")
    dealt = each.join(places, ["id", "key"]).select("key", "packed", F.explode("places").alias("to")).select("key", "packed", "to.*")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "member", "key").select("a", "part", "member", "key", "packed")
    out = checkpointed(dealt.mapInArrow(run, "src long, dst long").distinct())
    shared.destroy()
    return out


def _printed(firsts: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, a_id, b_id) of sets whose fingerprints the BK-trees link, and of sets that share one."""
    nodes = checkpointed(firsts.groupBy("fp").agg(F.min(F.struct("key", "id")).alias("first")).select("fp", F.col("first.key").alias("node"), F.col("first.id").alias("id")))
    others = firsts.select("fp", F.col("key").alias("y"), F.col("id").alias("y_id"))
    alike = others.join(nodes, "fp").where("y <> node").select(F.col("node").alias("x"), F.col("id").alias("x_id"), "y", "y_id")
    near = links(nodes.select("fp", "node"), radius).distinct()
    ids = nodes.select("node", "id")
    near = near.join(ids.select(F.col("node").alias("src"), F.col("id").alias("x_id")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("y_id")), "dst")
    both = alike.union(near.select(F.col("src").alias("x"), "x_id", F.col("dst").alias("y"), "y_id"))
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return checkpointed(both.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("x_id", "y_id").alias("a_id"), pick("y_id", "x_id").alias("b_id")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs with an id: (doc_id, version, component_id, first), component_id the least doc_id reachable over links.

    version is xxhash64(text), which tells rows of one id apart; first is true for one pair of doc_id and version of
    each component, the least. doc_id must be an integer. Texts without words are copies of each other; rows with a null
    id are left out, repeated rows are repeated. Further columns are ignored; an empty table gives an empty one.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("version"))
    rows = prefixes(docs, words)
    # the least row of each set stands for it; of rows with one id the text that verified() meets is the set's own
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("prefix").alias("prefix"))
    firsts = checkpointed(firsts)
    done = _printed(firsts, radius)
    found = verified(docs, checkpointed(marked(done, firsts)), words)
    linked = found
    entries = firsts.select("key", "id", "n", F.posexplode("prefix").alias("at", "shingle"))
    group = Window.partitionBy("shingle")
    open_ = entries.withColumn("size", F.count(F.lit(1)).over(group)).where("size > 1").drop("size")
    open_ = _different(open_.withColumn("component", F.col("key")), linked, group)
    for r in range(ROUNDS):
        # the first leader is the set with the most open shingles for its size, the one most like the others
        orders = [-F.col("open") / F.col("n"), *[F.xxhash64("key", F.lit(LEADERS * r + k)) for k in range(1, LEADERS)]]
        leads = [F.min(F.struct(x.alias("order"), "key", "id", "n", "at", "before", "component")).over(group) for x in orders]
        led = open_.select("*", *[x.alias(f"lead{k}") for k, x in enumerate(leads)])
        several = [F.struct(*[f"lead{k}.{c}" for c in ("key", "id", "n", "at", "before", "component")]) for k in range(LEADERS)]
        led = led.withColumn("lead", F.explode(F.array_distinct(F.array(*several))))
        led = led.where(F.col("lead.component") != F.col("component")).where(_possible(lambda c: F.col(f"lead.{c}"), F.col))
        swap = F.col("lead.key") > F.col("key")
        of = [F.when(swap, F.col(own)).otherwise(F.col(f"lead.{own}")) for own in ("key", "id", "n")]
        to = [F.when(swap, F.col(f"lead.{own}")).otherwise(F.col(own)) for own in ("key", "id", "n")]
        names = ("a", "a_id", "n", "b", "b_id", "m")
        # two leaders meet each other as lead and as member: once a shingle
        met = _candidates(led.select("shingle", *[c.alias(x) for c, x in zip(of + to, names, strict=True)]).distinct())
        new = checkpointed(met.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        done = done.select("a", "b").union(new.select("a", "b"))
        linked = linked.union(verified(docs, checkpointed(marked(new.select("a", "b", "a_id", "b_id"), firsts)), words))
        open_ = _different(open_, linked, group)
    x, y = open_.alias("x"), open_.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")))
    met = met.where(_possible(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & _first_shared(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    met = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")).distinct()
    rest = marked(met.join(done.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "a_id", "b_id"), firsts)
    linked = linked.union(verified(docs, checkpointed(rest), words))

    component = checkpointed(firsts.select("key").join(connected_components(linked).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    # copies of one text are few rows of one key after this partial aggregation
    least = rows.groupBy("key").agg(F.min(F.struct("doc_id", "version")).alias("least")).join(component, "key").groupBy("component").agg(F.min("least").alias("least"))
    named = checkpointed(component.join(least, "component").select("key", "least"))
    out = rows.select("doc_id", "version", "key").join(named, "key")
    return out.select("doc_id", "version", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "version") == F.col("least")).alias("first"))


def _different(entries: DataFrame, linked: DataFrame, group: WindowSpec) -> DataFrame:
    """entries with their components over the links so far, where a shingle's sets are in several: the open ones.

    Sets of different components share only open shingles. open: those of a set; before: those before this one; bits0 and on: a bitmap of them.
    """
    known = connected_components(linked).withColumnRenamed("node", "key")
    out = entries.select("key", "id", "n", "at", "shingle").join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    out = out.withColumn("some", F.min("component").over(group)).withColumn("other", F.max("component").over(group)).where("some <> other")
    own = Window.partitionBy("key").orderBy("at")
    out = out.drop("some", "other").withColumn("before", F.row_number().over(own) - 1)
    place, whole = F.xxhash64("shingle"), Window.partitionBy("key")
    lane, bit = F.pmod(F.shiftright(place, 6), F.lit(LANES)), F.expr("shiftleft(1L, cast(xxhash64(shingle) & 63 as int))")
    lanes = {f"bits{i}": F.bit_or(F.when(lane == i, bit).otherwise(F.lit(0))).over(whole) for i in range(LANES)}
    return checkpointed(out.withColumns({"open": F.count(F.lit(1)).over(whole), **lanes}))
