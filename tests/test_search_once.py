"""What a search over many blocks computes, and how often; the agent's queries retrieve what their rows need, once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.plans import agent

SF = "/root/testdata/sf0.001"


def test_vectors_are_computed_once_for_all_blocks(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector_of(i):
        met.add(1)
        return np.random.default_rng(i).integers(0, 9, 8).astype(float).tolist()

    vectors = spark.range(50).select(F.col("id").alias("vec_id"), vector_of("id").alias("embedding"), F.lit(0).alias("label"))
    queries = spark.range(40).select((-1 - F.col("id")).alias("qid"), F.sequence(F.col("id"), F.col("id") + 7).cast("array<double>").alias("qvec"))
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    assert len(vector.knn_blocks(vectors, queries, 3).collect()) == 120
    assert met.value == 50


def test_copies_and_close_scores(spark, monkeypatch):
    """Many equal vectors, and scores that single precision cannot tell apart."""
    rng = np.random.default_rng(3)
    data = np.concatenate([np.repeat(rng.integers(0, 5, (4, 16)), 40, axis=0), 1000 + rng.integers(0, 3, (140, 16)), np.zeros((3, 16))]).astype(float)
    data = data[rng.permutation(len(data))]
    vectors = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(data)], "vec_id long, embedding array<double>, label int").repartition(3)
    queries = vectors.where("vec_id < 60").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    monkeypatch.setattr(vector, "ROWS", 32)
    monkeypatch.setattr(vector, "QUERIES", 16)
    norm = np.sqrt((data * data).sum(axis=1))
    expected = []
    for q in range(60):
        scores = [(-round(float(data[i] @ data[q] / (norm[i] * norm[q])), 6), i) for i in range(len(data)) if i != q and norm[i] > 0 and norm[q] > 0]
        expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted(map(tuple, vector.knn_blocks(vectors, queries, 5).select("qid", "rank", "vec_id", "score").collect())) == expected


@pytest.mark.parametrize("name, rounds", [("agent_answer", [3]), ("agent_trace", [3]), ("final_state", [3]), ("decide_generate", [1]), ("fault_rows", [])])
def test_retrieves_what_is_needed_once(spark, monkeypatch, name, rounds):
    asked, retrieved = [], agent._retrieved

    def counted(spark, sf_dir, rounds=agent.ROUNDS):
        asked.append(rounds)
        return retrieved(spark, sf_dir, rounds)

    monkeypatch.setattr(agent, "_retrieved", counted)
    assert agent.QUERIES[name](spark, SF).columns
    assert asked == rounds
