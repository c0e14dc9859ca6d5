"""From raw documents to packed training sequences: quality, near-dedup, substring dedup, decontamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents. A stage begins
with give_back_heap(), so that an executor doesn't hold the heap of all stages beside its Python workers.
Columns beyond those, whatever their names, are left behind; null texts are empty, except that a text that a stage
doesn't change keeps its form; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, packing, quality, substring
from tessera.llm.common import sent
from tessera.session import checkpointed, give_back_heap, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (low quality or toxic) go. Repeated rows share their fate; a null source or lang is a site of its own."""
    give_back_heap(spark)
    return quality.classify(docs.select(*COLUMNS), _table(spark, sf_dir, "labels")).where("_keep").select(*COLUMNS)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more) the document with the least id stays.

    Rows that share an id are told apart by their texts; of rows equal in both one stays. A document with a null id stays.
    """
    give_back_heap(spark)
    docs = docs.select(*COLUMNS).withColumn("_version", F.xxhash64("text"))
    classes = checkpointed(jaccard.near_duplicates(docs))
    gone = checkpointed(classes.where("not first").select("doc_id", F.col("version").alias("_version")).distinct())
    rest = docs.join(sent(gone, 16), ["doc_id", "_version"], "left_anti")
    again = classes.where("first").groupBy("doc_id", F.col("version").alias("_version")).count().where("count > 1").select("doc_id", "_version")
    again = sent(checkpointed(again), 16)
    once = rest.join(again, ["doc_id", "_version"], "left_anti")
    return once.union(rest.join(again, ["doc_id", "_version"], "left_semi").select(once.columns).dropDuplicates(["doc_id", "_version"])).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out; a document with no word left goes. n_chars follows the text. A text without words stays as it is."""
    give_back_heap(spark)
    done = substring.drop_repeats(docs.select(*COLUMNS))
    return done.where("_n_removed < _n_words or _n_words = 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go. A null or empty text is clean."""
    give_back_heap(spark)
    return decontam.mark(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")).where("not _contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, as op8_packing packs them; repeated rows each on their own, a null text as its separator."""
    give_back_heap(spark)
    small_batches(spark)
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", keep_good), ("near_dedup", keep_first_copies), ("substring_dedup", remove_repeats), ("decontamination", keep_uncontaminated), ("packing", pack)]

#: The quality stage's regression and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the checkpoint folder for the next."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
