import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text, values
from tessera.operators import embedding, ingest, machine, memory, messages, models, search, sessions, telemetry, users
from tessera.sources.files import SearchConfig, config_snapshot
from tessera.streaming import threads


def one(spark, column, *rows, kind="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], kind).select(column).collect()]


def test_final_markers(spark):
    cases = [("a assistantfinal  b", "b"), ("a AssistantFinal b", "a AssistantFinal b"), ('x JSON\n\n {"a":1} ', '{"a":1}'), ('json{"a":1}', '{"a":1}'), ("json x", "json x"), ("\x1c a \x1f", "\x1c a \x1f"), ("assistantfinal \x1c a \x1f", "a"), (None, None)]
    assert one(spark, text.get_final(F.col("s")), *[a for a, _ in cases]) == [b for _, b in cases]
    assert one(spark, text.strip_space(F.col("s")), "\x1c  a b\x85\x1f", " ", "") == ["a b", "", ""]
    assert one(spark, models.error_text(F.col("s")), "<think>q</think> x assistantfinal y") == ["x assistantfinal y"]


def test_ids_as_the_standard_library_reads_them(spark):
    good = str(uuid.uuid4())
    cases = [good, good.upper(), good.replace("-", ""), "{" + good + "}", "urn:uuid:" + good, good[:-1], good + "0", "g" + good[1:], "", "not an id", good + "\n"]

    def plain(s):
        try:
            return str(uuid.UUID(s))
        except ValueError:
            return None

    assert one(spark, values.normalize_uuid(F.col("s")), *cases, None) == [*map(plain, cases), None]


def test_values(spark):
    assert one(spark, values.welcome(F.col("s")), "italian", "x", None) == [values.WELCOME["italian"], values.WELCOME["english"], values.WELCOME["english"]]
    items = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, values.pick_ordinal(F.col("s"), items), "1", "2", "3", "0", "-1", "x", "", None) == ["a", "b", None, None, None, None, None, None]
    spans = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:00:01.239' b").select(values.seconds_between(F.col("a"), F.col("b")))
    assert spans.first()[0] == 1.24
    assert abs((spark.range(1).select(F.unix_micros(values.now_utc().cast("timestamp")) - F.unix_micros(F.current_timestamp())).first()[0])) < 1e6


def test_graph_has_an_edge_for_every_step():
    drawn = machine.draw_graph()
    assert drawn.startswith("graph TD;") and drawn.count("\n") == len(machine.EDGES)
    assert "retrieval_grader -.-> generate;" in drawn and "retrieve --> retrieval_grader;" in drawn
    nodes = {a for a, _, _ in machine.EDGES}
    assert all(f"'{a}'" in machine._NEXT for a in nodes - {"conversational_agent", "generate_document_response", "generate_default_response"})


def test_messages_merge_by_id(spark):
    kind = "a array<struct<id:int,t:string>>, b array<struct<id:int,t:string>>"
    rows = [([(1, "x"), (2, "y")], [(2, "z"), (3, "w"), (3, "v")]), (None, [(1, "q")]), ([(1, "q")], None), ([], [])]
    got = [[tuple(m) for m in r[0]] for r in spark.createDataFrame(rows, kind).select(messages.add_messages(F.col("a"), F.col("b"))).collect()]
    assert got == [[(1, "x"), (2, "z"), (3, "v")], [(1, "q")], [(1, "q")], []]


def test_header_paths(spark):
    rng = random.Random(2)
    lines = [("#" * rng.randrange(1, 6) + f" h{i}" if rng.random() < 0.4 else f"text {i}") for i in range(120)]
    got = ingest.with_header_path(ingest.split_headers(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string"))).where("doc_id = 1").orderBy("part").collect()
    path, want = {}, [""] if not lines[0].startswith(("# ", "## ", "### ", "#### ")) else [""]
    for line in lines:
        level = len(line) - len(line.lstrip("#"))
        if 1 <= level <= 4 and line[level] == " ":
            path = {k: v for k, v in path.items() if k < level} | {level: line[level + 1 :]}
            want.append(" > ".join(path[k] for k in sorted(path)))
    assert [r["path"] for r in got] == want


def test_recursive_split(spark):
    rng = random.Random(3)
    body = "".join(rng.choice([f"word{i}", "".join(f"{i}-{j}-" for j in range(12)), " ", "\n", "\n\n", f"{i}. "]) for i in range(600))
    chunks = ingest.split_recursive(body, 50, 10)
    assert all(0 < len(c) <= 50 for c in chunks) and ingest.split_recursive("", 50, 10) == ingest.split_recursive(" \n", 50, 10) == []
    at = 0
    for c in chunks:  # in order, overlapping by 10 characters at most, and nothing but white space left out
        found = body.index(c, max(0, at - 10))
        assert not body[at:found].strip()
        at = max(at, found + len(c))
    assert not body[at:].strip()
    rows = ingest.chunk_recursive(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"), 50, 10).collect()
    assert [r["content"] for r in sorted(rows, key=lambda r: r["chunk"])] == chunks
    words = lambda: lambda t: [(i, i + 1) for i in range(len(t))]
    rows = ingest.chunk_tokenizer(spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string"), words, 4, 1).collect()
    assert [(r["content"], r["n_tokens"]) for r in sorted(rows, key=lambda r: r["chunk"])] == [("abcd", 4), ("defg", 4), ("ghij", 4), ("j", 1)]
    assert one(spark, ingest.compose(F.col("s")), "é", "abc", None) == ["é", "abc", None]


def test_search_manager(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie", "a"), (2, "green apple", "b"), (3, "blue sky", "b"), (4, None, "b"), (5, "", "a")], "doc_id long, text string, source string")
    embedding.index(docs, F.split("text", " "), F.col("source")).write.parquet(str(tmp_path / "index"))
    manager, questions = search.SearchManager(spark), spark.createDataFrame([(7, "apple pie"), (8, "nothing here"), (9, None)], "qid long, text string")
    config = SearchConfig.from_config({"top_k": 2})
    assert manager.get_retriever(str(tmp_path / "none"), config) is None and manager.search(str(tmp_path / "none"), config, questions).count() == 0
    assert manager.index(str(tmp_path / "index")) is manager.index(str(tmp_path / "index"))
    got = manager.search(str(tmp_path / "index"), config, questions).where("qid = 7").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    only = SearchConfig.from_config({"top_k": 5, "filename": ["b"]})
    assert {r["doc_id"] for r in manager.search(str(tmp_path / "index"), only, questions.where("qid = 7")).collect()} == {2, 3}
    both = SearchConfig.from_config({"top_k": 2, "fusion": True})
    found = manager.search(str(tmp_path / "index"), both, questions, docs)
    assert [r["doc_id"] for r in found.where("qid = 7").orderBy("rank").collect()] == [1, 2]
    lists = search.retrieved(questions, found, F.struct("rank", "doc_id")).orderBy("qid").collect()
    assert len(lists) == 3 and lists[2]["docs"] == []
    with pytest.raises(ValueError):
        search.make_searchable(docs, both)


def test_models(spark):
    def factory(role, temperature):
        return lambda prompts: prompts.map(lambda p: f"<think>x</think>{role} {temperature}: {p.splitlines()[-1]}")

    registry = models.Registry(factory, {"grader": 0.1})
    rows = spark.createDataFrame([("a",), (None,)], "q string")
    got = rows.select(models.ask(registry, "answer_grader", question=F.col("q"), generation="g", format_instructions="f").alias("x"), registry.column("router", F.col("q")).alias("y")).collect()
    assert [r["x"] for r in got] == ["grader 0.1: Answer: g"] * 2 and got[0]["y"] == "<think>x</think>router 0.0: a" and got[1]["y"] is None
    assert len(models.PROMPTS) == 13
    with pytest.raises(ValueError):
        registry.column("judge", F.col("q"))
    with pytest.raises(KeyError):
        models.render("answer_grader", question="q")
    assert models.batch_model(factory, "router", 0.0) is not None and isinstance(pd.Series([1]), pd.Series)


def test_users_and_sessions(spark):
    now = F.lit("2024-05-01 10:00:00")
    made = users.create_users(spark.createDataFrame([("ann", "a@x"), ("ann", "b@x")], "username string, email string"), now)
    assert made.schema.simpleString() == spark.createDataFrame([], users.SCHEMA).schema.simpleString()
    fixed = spark.createDataFrame([("u1", "ann", "user", "a@x", 1), ("u2", "ann", "user", "b@x", 0)], "user_id string, username string, user_role string, email string, m int").select("user_id", "username", "user_role", "email", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("m"), F.lit(0)).alias("created_at")).withColumn("last_active", F.col("created_at"))
    asked = spark.createDataFrame([(1, "u1", "zed", None), (2, None, "ann", "a@x"), (3, None, None, "a@x"), (4, None, None, None), (5, "", "", None), (6, "u9", "ann", "a@x")], "request_id int, user_id string, username string, email string")
    got = {r["request_id"]: (r["found"], r["user_id"]) for r in users.get_users(fixed, asked).collect()}
    assert got == {1: (True, "u1"), 2: (True, "u2"), 3: (True, "u1"), 4: (None, None), 5: (None, None), 6: (False, None)}
    made = sessions.create_sessions(fixed, now, "m", "e")
    assert made.schema.simpleString() == spark.createDataFrame([], sessions.SCHEMA).schema.simpleString()
    kept, gone = sessions.delete(made, made.where("service_user_id = 'u1'").select("session_id").union(spark.sql("select 'none'")))
    assert kept.count() == 1 and sorted(r["username"] or "" for r in gone.collect()) == ["", "ann"]


def test_memory_log_is_set_up_once(spark, tmp_path):
    path = str(tmp_path / "log")
    telemetry.setup(spark, path)
    log = spark.createDataFrame([(["conversation", "1"], "a", "x", 1, "put")], telemetry.LOG)
    telemetry.append(log, path)
    telemetry.setup(spark, path)
    assert memory.latest(spark.read.parquet(path)).count() == 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    kind = "conv_id long, turn long, role string, text string"

    def run():
        stream = spark.readStream.schema(kind).parquet(source)
        query = threads.thread_state(stream).writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
        query.awaitTermination()

    spark.createDataFrame([(1, 0, "user", "a")], kind).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(1, 1, "assistant", "b")], kind).write.mode("append").parquet(source)
    run()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, 2, 1, "assistant", "b")]


def test_config_snapshot():
    got = config_snapshot({"a": {"password": "x", "k": 3, "list": [1, object]}, "token": "y", "n": None})
    assert got["a"]["password"] == got["token"] == "***" and got["a"]["k"] == 3 and got["n"] is None and got["a"]["list"][0] == 1
