"""The search facade: a configuration becomes a function from questions, or query vectors, to ranked rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import embedding, sparse, vector
from tessera.sources.files import SearchConfig, load_index

FETCH_K = 20
Retriever = Callable[[DataFrame], DataFrame]


def _pool(vectors: DataFrame, config: SearchConfig) -> DataFrame:
    """The vectors that the metadata filter leaves: of one file, or of any in a list."""
    if config.filename is None:
        return vectors
    names = [config.filename] if isinstance(config.filename, str) else list(config.filename)
    return vectors.where(F.col("label").cast("string").isin(*names))


def retriever(vectors: DataFrame, config: SearchConfig) -> Retriever:
    """A function from queries (qid, qvec) to (qid, rank, vec_id, score). The metadata filter is applied before ranking."""
    k = config.kwargs.get("k", 3)
    pool = _pool(vectors, config)

    def similarity(queries: DataFrame) -> DataFrame:
        return vector.knn_blocks(pool, queries, k).select("qid", "rank", "vec_id", "score")

    def threshold(queries: DataFrame) -> DataFrame:
        # relevance rises with the cosine, so the best k by cosine hold all of the best k above the threshold
        scored = vector.knn_blocks(pool, queries, k).withColumn("score", F.round((1 + F.col("score")) / 2, 6))
        return scored.where(F.col("score") >= config.kwargs["score_threshold"]).select("qid", "rank", "vec_id", "score")

    def mmr(queries: DataFrame) -> DataFrame:
        best = vector.knn_blocks(pool, queries, config.kwargs.get("fetch_k", FETCH_K))
        picked = vector.mmr(best, pool, k)
        return picked.join(best, ["qid", "vec_id"]).select("qid", F.col("pick").alias("rank"), "vec_id", "score")

    return {"similarity": similarity, "similarity_score_threshold": threshold, "mmr": mmr}[config.type]


def make_searchable(vectors: DataFrame | None, config: SearchConfig, corpus: DataFrame | None = None) -> Retriever | None:
    """A function from questions (qid, text) to (qid, rank, doc_id, score), or None without an index.

    With fusion, the dense ranking and BM25 over corpus (doc_id, text) are fused by reciprocal ranks, each FETCH_K deep.
    """
    if vectors is None:
        return None
    k = config.kwargs.get("k", 3)

    def dense(questions: DataFrame, depth: int | None = None) -> DataFrame:
        vectors_of = questions.select("qid", embedding.embed(sparse.terms(F.col("text"))).alias("qvec"))
        own = config if depth is None else SearchConfig(config.type, config.kwargs | {"k": depth}, config.filename)
        # ids of questions and of documents are unrelated, and a vector is no neighbour of its own id: negative ids keep them apart
        found = retriever(vectors, own)(vectors_of.withColumn("qid", -1 - F.col("qid")))
        return found.select((-1 - F.col("qid")).alias("qid"), "rank", F.col("vec_id").alias("doc_id"), "score")

    def fused(questions: DataFrame) -> DataFrame:
        lexical = sparse.bm25(corpus, questions, FETCH_K)
        return sparse.fuse(dense(questions, FETCH_K), lexical, k).select("qid", "rank", "doc_id", "score")

    if config.fusion and corpus is None:
        raise ValueError("fusion needs a corpus")
    return fused if config.fusion else dense


@dataclass
class SearchManager:
    """Indexes by name, each loaded once; a missing one is remembered as such and never reaches a retriever."""

    spark: SparkSession
    loaded: dict[str, DataFrame | None] = field(default_factory=dict)

    def index(self, path: str) -> DataFrame | None:
        if path not in self.loaded:
            self.loaded[path] = load_index(self.spark, path)
        return self.loaded[path]

    def get_retriever(self, path: str, config: SearchConfig, corpus: DataFrame | None = None) -> Retriever | None:
        return make_searchable(self.index(path), config, corpus)

    def search(self, path: str, config: SearchConfig, questions: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Ranked documents of questions (qid, text); none without an index."""
        found = self.get_retriever(path, config, corpus)
        return self.spark.createDataFrame([], "qid long, rank int, doc_id long, score double") if found is None else found(questions)


def retrieved(questions: DataFrame, found: DataFrame, documents: Column) -> DataFrame:
    """questions with docs, their documents in rank order; an empty array where a question found none."""
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(documents)).alias("docs"))
    return questions.join(lists, "qid", "left").withColumn("docs", F.coalesce("docs", F.array().cast(lists.schema["docs"].dataType)))
