"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows are its runs of WINDOW words (all its words where it has fewer). An
occurrence must hold every word of the window, so by the prefix principle one token
of it is enough to find all candidates: its rarest, by counts over all documents. The
prefix tokens are joined with the documents' words; a candidate's place follows from the
token's position in the window and must lie inside the document, and then the
document's words at that place are compared with the whole window. Only DataFrame and
SQL functions are used.

A bitmap of the prefix tokens' hashes, BITMAP bits whatever the data, is a literal of the plan so
that only possible prefix tokens, each with the words around it, leave a document's row.
The join brings all windows of a token as one array, so a passage that many documents
share makes one row for each of its prefix tokens and not one for each window. Between the
tasks a window is a number; the items that have it are attached at the end, to the distinct windows
of a document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fits, free_name, sent, table
from tessera.session import checkpointed

#: Words of a window; a document is contaminated if 1 in SHARE of its words or more is hit.
WINDOW, SHARE = 13, 20
#: Bits of the literal bitmap, and parts into which a token's occurrences are dealt where the index is too large to broadcast.
BITMAP, SALTS = 1 << 16, 32

#: What stands between words, after lower-casing and before.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Lower-cases A-Z and takes the words; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _GAP), "")


def _bit(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BITMAP)).cast("int")


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (window, words), window being a number, and the items that have them as (window, item_id)."""
    items = benchmark.select("item_id", word_array(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0))))
    each = checkpointed(
        items.select("item_id", "all", starts.alias("at"))
        .select(F.slice("all", F.col("at") + 1, size).alias("words"), F.col("item_id").cast("string").alias("item_id"))
        .distinct()
    )
    found = checkpointed(each.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"))
    return found, checkpointed(each.join(found, "words").select("window", "item_id").where("item_id is not null"))


def prefix_index(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(token, windows): for each prefix token the windows that it stands for, as (offset, words, window)."""
    places = found.select("window", "words", F.posexplode("words").alias("offset", "token"))
    tokens = checkpointed(places.select("token").distinct())
    counts = (
        docs.select(F.explode(word_array(F.col("text"))).alias("token"))
        .join(sent(tokens, F.octet_length("token")), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = places.join(counts, "token").groupBy("window", "words").agg(F.min(F.struct("n", "token", "offset")).alias("rarest"), F.count(F.lit(1)).alias("present"))
    return (
        rarest.where(F.col("present") == F.size("words"))  # a window with a word that no document has occurs nowhere
        .groupBy(F.col("rarest.token").alias("token"))
        .agg(F.collect_list(F.struct(F.col("rarest.offset").alias("offset"), "words", "window")).alias("windows"))
    )


def occurrences(docs: DataFrame, found: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, version, hits) for texts with hits: hits are all occurrences of the windows found as (start, n, window). docs: (key, version, text).

    A place and a length have one window, so a text of n words has at most size * n hits.
    """
    index = checkpointed(prefix_index(docs, found))
    width = F.aggregate("windows", F.lit(0), lambda s, w: s + F.octet_length(F.array_join(w["words"], " ")) + 24 * F.size(w["words"]))
    small = fits(index, width)
    bits = index.select(_bit(F.col("token")).alias("bit"))
    lanes = bits.groupBy(F.shiftright("bit", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).collect()
    dense = [0] * (BITMAP >> 6)
    for r in lanes:
        dense[r["lane"]] = r["bits"]
    bitmap = F.from_json(F.lit(str(dense)), "array<bigint>")  # folded to a literal
    is_set = lambda bit: F.call_function("shiftright", F.get(bitmap, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    words = F.col("words")
    n = F.size(words)
    possible = F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_set(_bit(F.get(words, i))))
    around = F.transform(
        possible, lambda i: F.struct(i.alias("at"), F.get(words, i).alias("token"), F.slice(words, F.greatest(i - (size - 1), F.lit(0)) + 1, F.lit(2 * size - 1)).alias("near"))
    )
    met = (
        docs.select("key", "version", word_array(F.col("text")).alias("words"))
        .where(n > 0)
        .select("key", "version", n.alias("n"), F.explode(around).alias("met"))
        .select("key", "version", "n", "met.at", "met.token", "met.near")
    )
    start = lambda w: F.col("at") - w["offset"]
    inside = lambda w: (start(w) >= 0) & (start(w) + F.size(w["words"]) <= F.col("n"))
    low = F.greatest(F.col("at") - (size - 1), F.lit(0))
    exact = lambda w: F.slice("near", F.greatest(start(w) - low, F.lit(0)) + 1, F.size(w["words"])) == w["words"]
    hits = F.transform(
        F.filter("windows", lambda w: inside(w) & exact(w)),
        lambda w: F.struct(start(w).alias("start"), F.size(w["words"]).alias("n"), w["window"].alias("window")),
    )
    if small:
        joined = met.join(F.broadcast(index), "token")
    else:
        dealt = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = met.withColumn("salt", F.pmod(F.xxhash64("key", "version", "at"), F.lit(SALTS)).cast("int")).join(dealt, ["token", "salt"])
    return joined.select("key", "version", hits.alias("hits")).where(F.size("hits") > 0).groupBy("key", "version").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _covered(hits: Column) -> Column:
    """Words inside any of the spans."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["n"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda s: s["n"].cast("long"))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs with _n_words, _n_hit, _items (ids in the order of their strings) and _contaminated.

    A null text has no words and is never contaminated; an item without words has no window; an item whose
    id is null hits but isn't named. Rows that repeat a document id and text are each marked. Input
    columns of the four names are replaced; further columns pass through, whatever their
    names. An empty benchmark marks nothing, and an empty docs gives an empty table. Only texts with hits are
    joined back, by a broadcast where their hits are few.
    """
    docs = docs.drop("_n_words", "_n_hit", "_items", "_contaminated")
    key, version, hits, words = (free_name(x, docs.columns) for x in ("_key", "_version", "_hits", "_words"))
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _GAP_ANY_CASE), "")).cast("long")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), version: F.xxhash64("text"), words: n_words})
    parts, owners = windows(benchmark, size)
    found = checkpointed(
        occurrences(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("key"), F.xxhash64("text").alias("version"), "text"), parts, size)
        .select("key", "version", _covered(F.col("hits")).alias("n"), F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows"))
    )
    each = found.select("key", "version", F.explode("windows").alias("window")).join(sent(owners, F.octet_length("item_id")), "window")
    named = each.groupBy("key", "version").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = checkpointed(found.select("key", "version", "n").join(named, ["key", "version"], "left").select(F.col("key").alias(key), F.col("version").alias(version), F.struct("n", "items").alias(hits)))
    width = F.octet_length(F.col(key)) + 8 + F.coalesce(F.octet_length(F.array_join(F.col(f"{hits}.items"), " ")) + 16 * F.size(f"{hits}.items"), F.lit(0))
    joined = keyed.join(sent(named, width), [key, version], "left")
    n_hit = F.coalesce(F.col(f"{hits}.n"), F.lit(0).cast("long"))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(words).alias("_n_words"),
        n_hit.alias("_n_hit"),
        F.coalesce(F.col(f"{hits}.items"), F.array().cast("array<string>")).alias("_items"),
        ((n_hit > 0) & (n_hit * share >= F.col(words))).alias("_contaminated"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return mark(docs, benchmark).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


ORACLE = f"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
items AS (SELECT id, words, least(len(words), {WINDOW}) AS n FROM split WHERE kind = 'b' AND len(words) > 0),
windows AS (SELECT DISTINCT id, n, words[pos:pos + n - 1] AS words FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS pos FROM items)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT id, n, pos, words[pos:pos + n - 1] AS words
  FROM (SELECT s.id, s.words, l.n, unnest(range(1, len(s.words) - l.n + 2)) AS pos FROM split s, lengths l WHERE s.kind = 'd')),
hits AS (SELECT g.id AS doc_id, g.pos, g.n, w.id AS item_id FROM grams g JOIN windows w ON g.n = w.n AND g.words = w.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT s.id AS doc_id, coalesce(len(s.words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(s.words), 0) AS contaminated
FROM split s LEFT JOIN covered c ON c.doc_id = s.id LEFT JOIN named m ON m.doc_id = s.id WHERE s.kind = 'd'
"""
