from pyspark.sql import functions as F

from tessera.operators import vector


def test_queries_beyond_a_block_are_searched_too(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = vectors.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))

    def found():
        pairs = vector.ranked(vector.score_pairs(vectors, queries), 3).select("qid", "rank", "vec_id", "score").collect()
        knn = vector.knn_blocks(vectors, queries, 3).select("qid", "rank", "vec_id", "score").collect()
        return sorted(pairs), sorted(knn)

    whole = found()
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    assert found() == whole and len({r["qid"] for r in whole[0]}) == 40
