from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import text
from tessera.operators import ingest, machine, memory, vector
from tessera.sources.files import SearchConfig, load_index, read_json, write_json
from tessera.streaming import threads


def walk(request, kept, grounded, answered):
    """The machine as a plain loop."""
    trace, g, t, r = ["language_detector", "contextualize_question", "document_request_detector"], 0, 0, 0
    node = "retrieve"
    while node != "end":
        trace.append(node)
        if node == "retrieve":
            r, node = r + 1, "retrieval_grader"
        elif node == "retrieval_grader":
            node = "transform_question" if not kept[r - 1] else "generate" if request == "no" else "generate_document_response"
        elif node == "generate":
            g += 1
            node = "generate_default_response" if g > 2 else "generate" if not grounded[g - 1] else "end" if answered[g - 1] else "transform_question"
        elif node == "transform_question":
            t += 1
            node = "retrieve" if t <= 2 else "generate_default_response"
        else:
            node = "end"
    return trace, g, t, r


def test_machine_over_all_combinations(spark):
    cases = [(q, list(k), list(g), list(a)) for q in ("yes", "no") for k in product((0, 2), repeat=3) for g in product((True, False), repeat=3) for a in product((True, False), repeat=3)]
    frame = spark.createDataFrame([(i, "document_based", *c) for i, c in enumerate(cases)], "turn_id int, route string, doc_request string, kept array<int>, grounded array<boolean>, answered array<boolean>")
    for row in machine.run(frame).collect():
        assert (row["trace"], row["g"], row["t"], row["r"]) == walk(*cases[row["turn_id"]])
        assert row["status"] == "done" and len(row["trace"]) <= machine.MAX_STEPS and row["g"] <= 3 and row["t"] <= 3


def test_guards(spark):
    cases = [("<think>a\nb</think> x", "x"), ("<THINK>x</think>A<think>y</THINK>B", "AB"), ("<think>x", "<think>x"), ("  y ", "y"), ("", "")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "s string").select(text.strip_think(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == [b for _, b in cases]


def test_tail_and_zero(spark):
    row = spark.sql("select array(1, 2, 3) as m").select(text.tail(F.col("m"), 2).alias("a"), text.tail(F.col("m"), 9).alias("b"), text.tail(F.col("m"), 0).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ([2, 3], [1, 2, 3], [])


def test_delete_then_put_again(spark):
    log = spark.createDataFrame([(["conversation", "1"], "a", "x", 1, "put"), (["conversation", "1"], "a", "x", 2, "delete"), (["conversation", "1"], "a", "z", 3, "put"), (["conversation", "2"], "b", "y", 4, "put")], "namespace array<string>, key string, value string, seq long, op string")
    now = memory.latest(log)
    assert {r["value"] for r in now.collect()} == {"z", "y"}
    gone = spark.createDataFrame([("conversation", "2")], "kind string, session_id string")
    assert [r["value"] for r in memory.delete_prefix(now, gone).collect()] == ["z"]


def test_knn_blocks_equal_pairs(spark):
    v = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist(), 0) for i in range(40)], "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id < 6").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(vector.knn_blocks(v, q, 4)) == key(vector.ranked(vector.score_pairs(v, q), 4))


def test_sources(spark, tmp_path):
    assert load_index(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "index"))
    assert load_index(spark, str(tmp_path / "index")).count() == 3
    write_json(spark.range(2), str(tmp_path / "j"))
    assert read_json(spark, str(tmp_path / "j"), "id long").count() == 2
    assert SearchConfig.from_config({"top_k": 5, "score_threshold": 0.3}).kwargs == {"k": 5, "score_threshold": 0.3}
    with pytest.raises(ValueError):
        SearchConfig.from_config({"type": "other"})


def test_chunks_cover_the_text(spark):
    rows = ingest.chunk_characters(spark.createDataFrame([(1, "abcdefghij"), (2, "")], "doc_id long, text string"), 4, 1).orderBy("chunk").collect()
    assert [r["content"] for r in rows] == ["abcd", "defg", "ghij", "j"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string").write.parquet(source)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(source)
    query = threads.thread_state(stream).writeStream.outputMode("complete").format("memory").queryName("threads").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("threads").collect()} == {(1, 2, 1, "assistant", "b"), (2, 1, 0, "user", "c")}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15  # 5 ids of 500 are divisible by 100
    assert "vec_topk" in __spark_entry__.queries() and __spark_entry__.oracle_sql()
