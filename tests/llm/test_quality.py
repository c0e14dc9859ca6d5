import numpy as np

from tessera.llm import quality
from tests.llm import fixtures


def test_finds_labelled_defects(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.op7_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    bad = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1 or r["quality"] == 0}
    good = {r["doc_id"] for r in labels.collect()} - bad
    assert sum(got[i]["keep"] for i in good) >= 0.97 * len(good)
    assert sum(not got[i]["keep"] for i in bad) >= 0.8 * len(bad)


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(None, None, None, None, None), (3, "word", "en", "src0", 4), (3, "word", "en", "src0", 4)]))
    labels = spark.createDataFrame([(i, i % 2, 0 if i % 3 else None) for i in range(20)] + [(None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.classify(docs, known).collect()
        assert len(got) == docs.count()
        assert all(0 <= r["_p_low"] <= 1 and 0 <= r["_p_toxic"] <= 1 and r["score"] == "clash" for r in got)
        assert len({(r["_p_low"], r["_p_toxic"]) for r in got if r["doc_id"] == 3}) == 1
    assert all(r["_keep"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(fixtures.empty(spark), labels).count() == 0


def test_sparse_sites_shrink_more(spark):
    rows = [("h1", "p1", 3.0, -3.0)] * 400 + [("h2", "p2", 3.0, -3.0)] * 2 + [(f"g{i}", "p", -3.0, -3.0) for i in range(50) for _ in range(20)]
    evidence = spark.createDataFrame(rows, "host string, path string, low_llr double, toxic_llr double").selectExpr("*", "0D as low_prior", "0D as toxic_prior")
    rate = {r["host"]: r["path_rate_low"] for r in quality.site_rates(evidence).collect()}
    assert rate["h1"] > rate["h2"] > rate["g1"]


def test_regression_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4)) < 0.4
    bad = (rng.random(300) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 0, 1]) - 0.5)))).astype(float)
    w, b = quality._regress([np.flatnonzero(r).tolist() for r in x], bad, 4)
    g = 1 / (1 + np.exp(-(x @ w + b))) - bad
    assert abs(x.T @ g + quality.RIDGE * w).max() < 1e-2 and abs(g.sum()) < 1e-2
