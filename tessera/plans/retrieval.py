"""Retrieval queries: vectors from embeddings, text from documents, questions from benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import embedding, sparse, vector
from tessera.operators.search import FETCH_K, make_searchable, retriever
from tessera.sources.files import SearchConfig, load_index

K, THRESHOLD, POOL = 3, 0.6, 20
#: Rows whose id is divisible by this are the queries, against all rows.
EACH = 100
#: Labels of a filter by membership, and the label whose vectors are the examples to choose from.
LABELS, EXAMPLES = ("1", "3", "5"), "3"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _search(**config):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _vectors(spark, sf_dir)
        return retriever(vectors, SearchConfig.from_config({"top_k": K, **config}))(_queries(vectors))

    return query


def vec_knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return vector.knn_blocks(vectors, _queries(vectors), POOL).select("qid", "rank", "vec_id", "score")


def _text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % EACH == 0)
    return docs, questions.select(F.col("item_id").alias("qid"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.bm25(*_text(spark, sf_dir), K).select("qid", "rank", "doc_id", "score")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    dense = vector.knn_blocks(vectors, _queries(vectors), POOL).withColumnRenamed("vec_id", "doc_id")
    return sparse.fuse(dense, sparse.bm25(*_text(spark, sf_dir), POOL), K).select("qid", "rank", "doc_id", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text questions through the facade, with fusion."""
    docs, questions = _text(spark, sf_dir)
    index = embedding.index(docs, sparse.terms(F.col("text")), F.lit("all"))
    return make_searchable(index, SearchConfig.from_config({"top_k": K, "fusion": True}), docs)(questions).select("qid", "rank", "doc_id", "score")


def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_documents"))


def index_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, load_index(spark, f"{sf_dir}/{name}.parquet") is not None) for name in ("embeddings", "missing_index")]
    return spark.createDataFrame(found, "name string, found boolean")


def fewshot_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of the examples (the vectors of one label) to each query."""
    vectors = _vectors(spark, sf_dir)
    examples = vectors.where(F.col("label").cast("string") == EXAMPLES)
    return vector.knn_blocks(examples, _queries(vectors), 2).select("qid", "rank", "vec_id", "score")


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 6)"


def _scored(where: str = "true") -> str:
    return f"""scored AS (SELECT * FROM (SELECT q.vec_id AS qid, v.vec_id, v.embedding, {_cos("v.embedding", "q.embedding")} AS score
      FROM embeddings v JOIN embeddings q ON q.vec_id % {EACH} = 0 AND v.vec_id <> q.vec_id WHERE {where}) WHERE isfinite(score))"""


def _top(k: int = K, source: str = "scored", item: str = "vec_id") -> str:
    return f"SELECT qid, rank::INTEGER AS rank, {item}, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {item}) AS rank FROM {source}) WHERE rank <= {k}"


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
#: A text's words hashed into a vector of counts.
VECTOR = f"list_transform(range({embedding.DIMENSIONS}), lambda d: len(list_filter(list_transform({_TERMS}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {embedding.DIMENSIONS}), lambda h: h = d))::DOUBLE)"
_BM25 = f"""words AS (SELECT doc_id, {_TERMS} AS w FROM documents),
  stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM words),
  wanted AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark WHERE item_id % {EACH} = 0),
  postings AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  bm25 AS (SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {sparse.K1 + 1}
      / (tf + {sparse.K1} * (1 - {sparse.B} + {sparse.B} * dl / avgdl))), 6) AS score
    FROM wanted JOIN postings USING (term) JOIN df USING (term), stats GROUP BY ALL)"""
_MMR = f"""WITH {_scored()}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= {POOL}),
  first AS (SELECT * FROM pool WHERE r = 1),
  two AS (SELECT p.*, row_number() OVER (PARTITION BY p.qid ORDER BY round(0.5 * p.score - 0.5 * {_cos("p.embedding", "f.embedding")}, 6) DESC, p.vec_id) AS n
    FROM pool p JOIN first f ON f.qid = p.qid AND f.vec_id <> p.vec_id),
  second AS (SELECT * FROM two WHERE n = 1),
  three AS (SELECT p.*, row_number() OVER (PARTITION BY p.qid ORDER BY round(0.5 * p.score - 0.5 * greatest({_cos("p.embedding", "f.embedding")}, {_cos("p.embedding", "s.embedding")}), 6) DESC, p.vec_id) AS n
    FROM pool p JOIN first f ON f.qid = p.qid AND f.vec_id <> p.vec_id JOIN second s ON s.qid = p.qid AND s.vec_id <> p.vec_id)
  SELECT qid, 1::INTEGER AS rank, vec_id, score FROM first UNION ALL SELECT qid, 2::INTEGER, vec_id, score FROM second UNION ALL SELECT qid, 3::INTEGER, vec_id, score FROM three WHERE n = 1"""

QUERIES = {
    "vec_topk": _search(),
    "vec_threshold": _search(type="similarity_score_threshold", score_threshold=THRESHOLD),
    "vec_mmr": _search(type="mmr", fetch_k=POOL),
    "vec_topk_filter_eq": _search(filename="3"),
    "vec_topk_filter_in": _search(filename=list(LABELS)),
    "vec_knn_blocks": vec_knn_blocks,
    "bm25_topk": bm25_topk,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_search": hybrid_search,
    "index_count": index_count,
    "index_exists": index_exists,
    "fewshot_select": fewshot_select,
}
ORACLES = {
    "vec_topk": f"WITH {_scored()} {_top()}",
    "vec_threshold": f"WITH {_scored()}, kept AS (SELECT qid, vec_id, round((1 + score) / 2, 6) AS score FROM scored WHERE round((1 + score) / 2, 6) >= {THRESHOLD}) {_top(source='kept')}",
    "vec_mmr": _MMR,
    "vec_topk_filter_eq": f"WITH {_scored(where='v.label = 3')} {_top()}",
    "vec_topk_filter_in": f"WITH {_scored(where=f"v.label IN ({', '.join(LABELS)})")} {_top()}",
    "vec_knn_blocks": f"WITH {_scored()} {_top(POOL)}",
    "bm25_topk": f"WITH {_BM25} {_top(source='bm25', item='doc_id')}",
    "hybrid_rrf": f"""WITH {_scored()}, dense AS ({_top(POOL)}), {_BM25}, lexical AS ({_top(POOL, 'bm25', 'doc_id')}),
      fused AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.vec_id, l.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / ({sparse.FUSION} + d.rank), 0) + coalesce(1.0::DOUBLE / ({sparse.FUSION} + l.rank), 0), 6) AS score
        FROM dense d FULL JOIN lexical l ON l.qid = d.qid AND l.doc_id = d.vec_id) {_top(source='fused', item='doc_id')}""",
    "hybrid_search": f"""WITH embedded AS (SELECT doc_id, {VECTOR} AS v FROM documents), asked AS (SELECT item_id AS qid, {VECTOR} AS v FROM benchmark WHERE item_id % {EACH} = 0),
      scored AS (SELECT * FROM (SELECT qid, doc_id, {_cos("e.v", "a.v")} AS score FROM embedded e, asked a) WHERE isfinite(score)), dense AS ({_top(FETCH_K, item='doc_id')}), {_BM25}, lexical AS ({_top(FETCH_K, 'bm25', 'doc_id')}),
      fused AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.doc_id, l.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / ({sparse.FUSION} + d.rank), 0) + coalesce(1.0::DOUBLE / ({sparse.FUSION} + l.rank), 0), 6) AS score
        FROM dense d FULL JOIN lexical l ON l.qid = d.qid AND l.doc_id = d.doc_id) {_top(source='fused', item='doc_id')}""",
    "index_count": "SELECT count(*) AS n_documents FROM embeddings",
    "fewshot_select": f"WITH {_scored(where=f'v.label = {EXAMPLES}')} {_top(2)}",
}
