import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import substring
from tessera.session import checkpointed
from tests.llm import fixtures


def plain(docs, window=20):
    """{doc_id: (n_words, n_removed, sha)} for rows with distinct ids."""
    found = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(found, key=lambda d: (d is not None, d)):
        words, hit = found[d], set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                hit.update(range(i, i + window))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in hit)
        out[d] = (len(words), len(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(rows):
    return {r["doc_id"]: (r["_n_words"], r["_n_removed"], r["_kept_sha256"]) for r in rows}


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(None, fixtures.rows()[13][1], "en", None, 1)]))
    rows = substring.drop_repeats(docs).collect()
    want = plain([(d["doc_id"], d["text"]) for d in docs.collect()])
    assert got(rows) == want
    assert sum(x[1] for x in want.values()) > 100
    assert all(r["n_words"] == "clash" for r in rows)
    assert substring.drop_repeats(fixtures.empty(spark)).count() == 0


def test_rows_that_repeat_a_document(spark):
    text = fixtures.rows()[13][1]
    rows = substring.drop_repeats(fixtures.frame(spark, [(13, text, "en", "src0", 1)])).where("doc_id = 13").collect()
    assert len(rows) == 2 and rows[0][5:] == rows[1][5:] and rows[0]["text"] == rows[1]["text"]


@pytest.mark.parametrize("seed", range(3))
def test_random_and_periodic_texts(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randrange(40))] for _ in range(6)]
    docs = [(i, " ".join(sum((rng.choice(base) for _ in range(rng.randrange(5))), []))) for i in range(120)]
    docs += [(200 + i, " ".join((base[i][: i + 1] or ["z"]) * 30)) for i in range(6)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert got(substring.drop_repeats(frame).collect()) == plain(docs)


@pytest.mark.parametrize("group_rows", [1 << 16, 3])
def test_heavy_anchors(spark, monkeypatch, group_rows):
    """Around a common passage all windows differ; every anchor counts as heavy here, and groups are compared in parts."""
    monkeypatch.setattr(substring, "GROUP_ROWS", group_rows)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(25)) + " " + passage + f" e{i} " + " ".join(f"v{rng.randrange(3)}" for _ in range(30))) for i in range(150)]
    docs += [(500 + i, docs[0][1]) for i in range(20)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert got(substring.drop_repeats(frame, heavy=2).collect()) == plain(docs)


def test_given_documents(spark):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{fixtures.SF}/documents.parquet").collect()]
    rows = substring.op6_substring(spark, fixtures.SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == plain(docs)


def test_merged_sketches_never_underestimate(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 90)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    value = np.concatenate([v[np.concatenate([[True], np.diff(at) != 0])] for _, _, words in substring.held_words([t.encode() for _, t in docs], 20) for _, v, at in [substring.anchors(words, 20, 8)]])
    values, counts = np.unique(value, return_counts=True)
    for bits in (16, 20):
        estimate = substring.Estimate(checkpointed(substring.sketch(frame, bits)), bits, 3)
        assert estimate.repeated(values[counts > 1]).all() and estimate.common(values[counts > 2]).all()
        assert estimate.repeated(values[counts == 1]).mean() < 0.1
    assert not substring.Estimate(checkpointed(substring.sketch(frame.limit(0), 16)), 16, 3).twice.any()


def test_width_follows_the_text_up_to_a_bound(spark):
    docs = fixtures.frame(spark)
    assert substring.MIN_BITS == substring.sketch_bits(docs) < substring.sketch_bits(docs.select(F.repeat("text", 30).alias("text"))) <= substring.MAX_BITS
    assert substring.sketch_bits(fixtures.empty(spark)) == substring.MIN_BITS


def test_long_texts_in_sections(spark, monkeypatch):
    text = " ".join(f"w{i % 977} {i}\t" for i in range(2000)).encode()
    full = substring.Words([text])
    where, value, at = substring.anchors(full, 20, 8)
    monkeypatch.setattr(substring, "TEXT_BYTES", 500)
    got = []
    for owner, skipped, words in substring.held_words([b"", b"a b", text], 20):
        w, v, _ = substring.anchors(words, 20, 8)
        part = words.text[w]
        assert set(owner[part]) <= {2}
        got += zip((w - words.first[part] + skipped[part]).tolist(), v.tolist())
    assert got == list(zip(where.tolist(), value.tolist()))
    long = " ".join(f"x{i}" for i in range(400_000))
    docs = [(0, long), (1, "head " + long[-3000:] + " tail " + long[:3000]), (2, long)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["_n_removed"] for r in substring.drop_repeats(frame).collect()}[2] == 400_000


def test_least():
    value, at = substring._least(np.array([3, 1, 1, 2]), 2)
    assert (value.tolist(), at.tolist()) == ([1, 1, 1], [1, 1, 2])


def test_only_texts_with_spans_are_sent_to_be_joined(spark):
    keyed = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    by_text = checkpointed(keyed.where("k % 10 = 0"))
    rows = keyed.withColumn("marked", substring._marked(by_text, "k", "v")).collect()
    assert all(r["marked"] for r in rows if r["k"] % 10 == 0)
    assert sum(r["marked"] for r in rows) < 200 + 1800 / 8
    plan = substring.drop_repeats(fixtures.frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "Union" in plan[: plan.index("Join")] and "ArrowEvalPython" in join
