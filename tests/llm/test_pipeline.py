import pytest

import corpus_pipeline
from tessera import session
from tests.llm import fixtures
from tests.llm.test_decontam import plain
from tests.llm.test_jaccard import plain_components
from tests.llm.test_substring import plain as plain_repeats


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, fixtures.SF)
    assert good.columns == columns and 0.5 * docs.count() < good.count() <= docs.count()
    good = spark.createDataFrame(good.collect(), docs.schema)
    before = {r["doc_id"]: r["text"] for r in good.collect()}
    first = stage["near_dedup"](spark, good, fixtures.SF)
    component = plain_components(before)
    assert {r["doc_id"] for r in first.collect()} == {i for i, c in component.items() if i == c}
    cut = stage["substring_dedup"](spark, first, fixtures.SF)
    kept = plain_repeats([(r["doc_id"], r["text"]) for r in first.collect()])
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and got.keys() == {i for i, (n, gone, _) in kept.items() if gone < n or not n}
    assert all(len(r["text"].split()) == kept[i][0] - kept[i][1] and r["n_chars"] == len(r["text"]) for i, r in got.items())
    clean = stage["decontamination"](spark, cut, fixtures.SF)
    items = [tuple(r) for r in spark.read.parquet(f"{fixtures.SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in plain([(i, r["text"]) for i, r in got.items()], items) if not r[4]}
    packed = stage["packing"](spark, clean, fixtures.SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    def write(name, docs):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            rows = spark.read.parquet(f"{fixtures.SF}/{t}.parquet")
            (rows if name == "rows" else rows.limit(0)).write.parquet(f"{folder}/{t}.parquet")
        return folder

    awkward = fixtures.clashing(fixtures.frame(spark, [(None, "null id", None, None, None), (3, "word", "en", "src0", 4)]))
    folder = write("rows", awkward)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert None in {r["doc_id"] for r in packed} and len({r["doc_id"] for r in packed}) > 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, folder).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, write("none", fixtures.empty(spark))).count() == 0


def test_near_dedup_of_repeated_and_clashing_ids(spark):
    """Rows of one id are told apart by their texts: none goes with another's copy, and of equal rows one stays."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (3, text, "en", "s", 1), (3, "a text of its own, with seven words", "en", "s", 1), (5, "twice the same row", "en", "s", 1), (5, "twice the same row", "en", "s", 1)]
    rows += [(None, text, None, None, None), (None, text, None, None, None), (7, None, "en", "s", 0), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(4)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, fixtures.SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, text), (3, rows[2][1]), (5, rows[3][1]), (0, text), (0, text), (7, "")])


def test_each_stage_begins_by_giving_back_heap(spark, monkeypatch):
    class Begun(Exception):
        pass

    def begin(given):
        assert given is spark
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "give_back_heap", begin)
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, docs, fixtures.SF)


def test_heap_is_given_back(spark):
    """The tasks have the JVM collect all of its garbage."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(x.getCollectionCount() for x in beans() if "Young" not in x.getName())
    before = full()
    session.give_back_heap(spark)
    assert full() > before
