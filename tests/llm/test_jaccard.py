import random

import pytest

import corpus_pipeline
from tessera.llm import jaccard
from tests.llm import fixtures


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_components(docs):
    """Least id reachable over all pairs of five-word Jaccard similarity 0.8 or more, for {id: text}."""
    sets, parent = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in docs}


def copies():
    """Texts with copies of falling similarity, chains of them, and one line that many share."""
    rng, out = random.Random(5), []
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line = say(12)
    for n in (9, 30, 120, 500):
        for _ in range(12):
            text = say(n) + (line if rng.random() < 0.7 else [])
            for _ in range(8):
                out.append(" ".join(text))
                for _ in range(rng.randrange(1, 2 + n // 40)):
                    text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("often", [8, 2])
def test_near_copies_against_all_pairs(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "COMMON", often)
    texts = copies()
    want = plain_components(texts)
    assert 60 < len(set(want.values())) < 300
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], fixtures.SCHEMA).repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, fixtures.SF).collect()} == {i for i, c in want.items() if i == c}


def test_given_documents_and_awkward_rows(spark):
    given = spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    docs = fixtures.clashing(fixtures.frame(spark, [(None, "word", None, None, None)]))
    for table in (given, docs):
        want = plain_components({r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] is not None})
        assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table).collect()} == want
    assert jaccard.near_duplicates(fixtures.empty(spark)).count() == 0


def test_blocks_of_the_bitmap(spark):
    cells = spark.createDataFrame([(5,), (13,), (3 << 20,)], "cell long")
    assert {k: v.tolist() for k, v in jaccard.bitmap(cells, 3).items()} == {0: [1 << 5 | 1]}
    blocks = jaccard.bitmap(cells, 22)
    assert set(blocks) == {0, (3 << 20) >> 16}
    assert jaccard._has(blocks, jaccard.np.array([5, 6, 13, 3 << 20, 1 << 21]), 22).tolist() == [True, False, True, True, False]
