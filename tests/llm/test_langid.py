import numpy as np

from tessera.llm import langid
from tests.llm import fixtures


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = langid.op5_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = [r for r in held if not r["rejected"]]
    assert len(kept) >= 0.9 * len(held) and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in kept) >= 0.98 * len(kept)


def test_awkward_rows(spark):
    known = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None), ("", "fr")] * 3)] + [(None, "abc", "en")], "doc_id long, text string, lang string")
    models = langid.fit(known, rows=3, fit_rows=1)
    assert models.languages == ["de", "en"]
    docs = fixtures.clashing(fixtures.frame(spark, [(None, None, None, None, None), (0, "THE DOG", None, None, None)]))
    got = langid.identify(docs, models).collect()
    assert len(got) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] and not any(c.isalpha() for c in text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    assert {(r["lang_pred"]) for r in got if r["doc_id"] == 0} == {"und", "en"}
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, langid.fit(known.limit(0))).collect())
    assert langid.identify(fixtures.empty(spark), models).count() == 0
    models.reject_below = 1.1
    assert {r["lang_pred"] for r in langid.identify(docs, models, reject=True).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(docs, models).collect() if not r["rejected"]} == set()


def test_calibrated_bound():
    scores, right = np.array([0.9, 0.8, 0.7, 0.7, 0.6, 0.5]), np.array([True, True, True, False, True, False])
    for precision in (0.5, 0.75, 0.8, 0.99, 1.0):
        bound = langid.calibrate(scores, right, precision)
        fine = [b for b in scores if right[scores >= b].mean() >= precision]
        assert bound == min(fine)
    assert langid.calibrate(np.array([0.4, 0.4]), np.array([True, False]), 0.9) > 0.4
    assert langid.calibrate(np.empty(0), np.empty(0, bool)) == 0


def test_probabilities_sum_to_one():
    x = langid.encode("abracadabra abacus cab")
    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(x, langid.ORDER), axis=0, return_counts=True)
    models = langid.Models({"a": langid.kneser_ney(grams, n), "b": langid.kneser_ney(grams[:3], n[:3])})
    every = np.arange(langid.ALPHABET, dtype=np.uint32)
    for history in ("abr", "zzz", " ab", "   "):
        rows = np.concatenate([np.tile(np.array([*map(ord, history)], np.uint32), (len(every), 1)), every[:, None]], axis=1)
        assert np.allclose(np.exp(models._logs(3, rows).astype(float)).sum(axis=0), 1, atol=1e-3)
