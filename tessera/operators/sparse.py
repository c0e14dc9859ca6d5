"""Sparse retrieval: BM25 over an inverted list, and reciprocal rank fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vector import ranked

K1, B, FUSION = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each query: (qid, doc_id, score, rank). corpus (doc_id, text), queries (qid, text).

    Lengths come from one narrow pass; postings are restricted to query terms before they are
    counted, so what is shuffled follows the queries and not the whole vocabulary.
    """
    wanted = queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = corpus.select("doc_id", terms(F.col("text")).alias("words"))
    sized = words.select("doc_id", F.size("words").alias("dl"), "words")
    stats = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = stats["n_docs"], stats["avgdl"] or 1.0
    postings = (
        sized.select("doc_id", "dl", F.explode("words").alias("term"))
        .join(wanted.select("term").distinct(), "term", "left_semi")
        .groupBy("term", "doc_id", "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
    scored = wanted.join(postings.join(df, "term"), "term").groupBy("qid", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scored, k, item="doc_id")


def fuse(left: DataFrame, right: DataFrame, k: int, c: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of two rankings (qid, doc_id, rank); a missing list adds nothing."""
    part = lambda x: F.coalesce(1.0 / (c + F.col(x)), F.lit(0.0))
    both = left.select("qid", "doc_id", F.col("rank").alias("r1")).join(right.select("qid", "doc_id", F.col("rank").alias("r2")), ["qid", "doc_id"], "full_outer")
    return ranked(both.select("qid", "doc_id", F.round(part("r1") + part("r2"), 6).alias("score")), k, item="doc_id")
