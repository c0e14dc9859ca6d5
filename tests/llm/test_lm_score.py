import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm_score
from tests.llm import fixtures


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def check(got, docs):
    counts = Counter(t for i, x in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in docs:
        own = tokens(x)
        want.append((i, len(own), sum(t in counts for t in own), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)))
    key = lambda r: (str(r[0]), *r[1:])
    for a, b in zip(sorted(want, key=key), sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(None, "x y", None, None, None), (3, "word", None, None, None)]))
    for head in (3, 1000):
        got = lm_score.score(docs, docs.where(~lm_score.is_held_out()), head=head).collect()
        check(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
        assert all(r["score"] < 0 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert lm_score.score(fixtures.empty(spark), docs).count() == 0
    assert {r["train_tokens"] for r in lm_score.score(docs, docs.limit(0)).collect()} == {0}


def test_given_documents(spark):
    got = lm_score.op4_lm_score(spark, fixtures.SF).collect()
    check(got, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{fixtures.SF}/documents.parquet").collect()])
    assert sum(r["bits_per_byte"] for r in got) < 2.7 * len(got)


def whole(text):
    return list(lm_score.parts(text))


def test_probabilities_of_a_byte_sum_to_one(spark):
    docs = fixtures.frame(spark)
    mixer = lm_score.train(docs, lm_score.token_counts(docs))
    code, word, _ = lm_score.positions(whole(b"The alpha beta"))
    for at in (0, 3, 8):
        every = (code[at] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert (10 ** mixer.logs(every, np.full(256, word[at]))).sum() == pytest.approx(1, abs=1e-4)
    cache = lm_score.Cache(mixer)
    for _ in range(2):
        assert np.allclose(cache.logs(code, word), mixer.logs(code, word), atol=1e-5)


def plain_counts(docs):
    """{(context, bits so far): [zeros, ones]}, contexts as (length, bytes); words with a space after them, the end by itself."""
    counts = {}

    def add(context, symbol):
        bits = f"{symbol:08b}"
        for b in range(8):
            counts.setdefault((context, bits[:b]), [0, 0])[int(bits[b])] += 1

    for text in docs:
        data = b"\n" * 5 + lm_score.canonical(text)
        for i in range(5, len(data)):
            for order in lm_score.ORDERS:
                if order:
                    add((order, data[i - order : i]), data[i])
        for word in [*(x + b" " for x in text.lower().split()), b"\n"]:
            for i in range(len(word)):
                add((0, word[:i]), word[i])
    return counts


def plain_score(text, counts, mixer):
    """log10 probability of a text, bit by bit with dictionaries instead of hashed tables."""
    data, total = b"\n" * 5 + lm_score.canonical(text), 0.0
    for i in range(5, len(data)):
        word, bits = re.split(rb"[ \n]", data[:i])[-1], f"{data[i]:08b}"
        for b in range(8):
            x, known = [], []
            for order in lm_score.ORDERS:
                zero, one = counts.get(((order, data[i - order : i]) if order else (0, word), bits[:b]), (0, 0))
                x.append(max(-8, min(8, math.log(one + 0.3) - math.log(zero + 0.3))))
                known.append(min(7, min(64, min(zero, 64) + min(one, 64)).bit_length()))
            z = sum(a * w for a, w in zip([*x, 0.3], mixer.weights[b][known[-2] * 8 + known[-1]], strict=True))
            z = max(-30, min(30, z))
            place = (max(-7.999, min(7.999, z)) + 8) * 2
            low = mixer.map[int("1" + bits[:b], 2)][int(place) : int(place) + 2]
            p = 0.5 / (1 + math.exp(-z)) + 0.5 * (low[0] * (1 - place % 1) + low[1] * (place % 1))
            p = max(1e-5, min(1 - 1e-5, p))
            total += math.log10(p if bits[b] == "1" else 1 - p)
    return total


def test_score_against_a_plain_loop(spark):
    """Tables with room for every context have next to no collisions; what they hold is what plain dictionaries count."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "the", "of"], n))
    texts = [say(int(n)) for n in rng.integers(1, 60, 40)] + ["", "\n", "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    mixer = lm_score.train(docs, lm_score.token_counts(docs))
    counts = plain_counts([t.encode() for t in texts])
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, docs).collect()}
    for i in (0, 5, 17, 40, 41, 42):
        assert got[i] == pytest.approx(plain_score(texts[i].encode(), counts, mixer), rel=0.03)


def test_long_texts_go_in_parts(spark, monkeypatch):
    size = lm_score.CHUNK
    text = "ab cd " * size + "y" * (size + 7) + " ef " * 300 + "z" * size + "\t " + "u" * (3 * size)
    docs = spark.createDataFrame([(0, text), (1, "ab " + "y" * (size + 7) + " cd")], "doc_id long, text string")
    got = sorted(map(tuple, lm_score.score(docs, docs).select("doc_id", "n_tokens", "n_known", "n_bytes", "score").collect()))
    assert [r[:4] for r in got] == [(i, len(t.split()) + 1, len(t.split()) + 1, len(lm_score.canonical(t.encode()))) for i, t in ((0, text), (1, "ab " + "y" * (size + 7) + " cd"))]
    assert all(r[4] < 0 for r in got)
    for limit in (size, 256, 7):
        monkeypatch.setattr(lm_score, "CHUNK", limit)
        found = whole(text.encode())
        assert b"".join(x for _, x in found) == lm_score.canonical(text.encode()) and max(len(x) for _, x in found) <= limit
        code, _, _ = lm_score.positions(found[:50])
        assert (code == lm_score.positions([(b"\n" * 5, b"".join(x for _, x in found[:50]))])[0]).all()


def test_learning_covers_all_tasks(spark):
    """The sums count one bit decision for EVERY bytes of all partitions."""
    docs = fixtures.frame(spark).repartition(6)
    mixer = lm_score.train(docs, lm_score.token_counts(docs))
    size = sum(len(lm_score.canonical((r["text"] or "").encode())) for r in docs.collect())
    assert mixer.seen[0].sum() == pytest.approx(size / lm_score.EVERY, rel=0.01)


def test_counts_of_words_and_grams(spark):
    code, word, doc = lm_score.positions([(b"\n" * 5, b"ab ab\n"), (b"\n" * 5, b"\n")])
    assert doc.tolist() == [0] * 6 + [1]
    assert word[0] == word[3] == word[6] and word[1] == word[4] and word[2] == word[5] and len({*word.tolist()}) == 3
    assert [int(c) & 0xFFFF for c in code[:2]] == [10 << 8 | ord("a"), ord("a") << 8 | ord("b")]


def test_frequent_tokens_stay_within_their_bound(spark):
    counts = {f"w{i}": 1 + 1000 // i for i in range(1, 200)} | {"x" * (lm_score.HEAD_BYTES + 1): 5000}
    rows = spark.createDataFrame([(t.encode(), n) for t, n in counts.items()], "token binary, n long").repartition(7)
    for head in (0, 1, 10, 50, 1000):
        got = lm_score.frequent(rows, head)
        taken = {t for t in counts if t.encode() in got or lm_score._key(t.encode()) in got}
        assert len(got) == len(taken) <= head and sorted(got.values()) == sorted(counts[t] for t in taken)
        rest = [n for t, n in counts.items() if t not in taken]
        assert not got or not rest or min(got.values()) > max(rest)
    assert len(lm_score.frequent(rows, 10)) >= 9 and len(lm_score.frequent(rows, 1000)) == 200
    assert lm_score.frequent(rows.limit(0)) == {}


def test_every_bit_of_every_byte_is_learned():
    """Learning from a text is learning from each of its bytes, with all its bits, as often as it is met."""
    text = b"ab cd ab ce ab cd\n" * 30
    code, word, _ = lm_score.positions([(b"\n" * 5, text)])
    bits = {o: 10 for o in lm_score.ORDERS}
    counts = {o: np.random.default_rng(o).integers(0, 40, (2, 1 << 10)).astype(np.uint16) for o in lm_score.ORDERS}
    mixer = lm_score.Mixer(bits)
    start = mixer.weights.copy()
    mixer.learn(counts, code, word)
    symbols = np.frombuffer(text, np.uint8)
    for b in range(8):
        met = np.bincount((1 << b) | (symbols.astype(np.int64) >> (8 - b)), minlength=256)
        assert mixer.seen[0].sum(axis=1)[1 << b : 2 << b] == pytest.approx(met[1 << b : 2 << b])
    # one step: the curvature is the sum over all occurrences at the starting weights
    assert len({*zip(code.tolist(), word.tolist(), strict=True)}) < lm_score.STEP
    expected = np.zeros_like(mixer.curvature)
    for b in range(8):
        bit, node = (symbols.astype(np.int64) >> b) & 1, (1 << (7 - b)) | (symbols.astype(np.int64) >> (b + 1))
        x, gate = mixer.inputs(counts, lm_score._contexts(code, word), node, bit)
        p = 1 / (1 + np.exp(-np.clip((x * start[7 - b][gate]).sum(axis=1), -30, 30)))
        np.add.at(expected[7 - b], gate, x[:, :, None] * x[:, None, :] * np.maximum(p * (1 - p), lm_score.LEAST_CURVE)[:, None, None])
    assert np.allclose(mixer.curvature, expected, rtol=1e-4)


def test_a_tally_counts_every_pair(monkeypatch):
    """Small tallies put most pairs aside and are taken often; what they count in all is what plain counting gives."""
    rng = np.random.default_rng(5)
    code, word = rng.zipf(1.2, 20_000).astype(np.uint64) % np.uint64(3000), rng.integers(0, 3, 20_000).astype(np.uint64)
    want = Counter(zip(code.tolist(), word.tolist(), strict=True))
    for bits in (4, 9, 16):
        monkeypatch.setattr(lm_score, "TALLY_BITS", bits)
        tally, got = lm_score.Tally(2), Counter()

        def take(tally=tally, got=got):
            (c, w), n = tally.take()
            pairs = list(zip(c.tolist(), w.tolist(), strict=True))
            assert len(pairs) == len(n)
            for pair, k in zip(pairs, n.tolist(), strict=True):
                got[pair] += k

        for at in range(0, len(code), 700):
            tally.add(code[at : at + 700], word[at : at + 700])
            if tally.full():
                take()
        take()
        take()
        assert got == want


def test_a_task_evaluates_equal_pairs_once(spark, monkeypatch):
    """Text that comes again later in a task costs no further evaluations, and counts as often as it is met."""
    text = " ".join(f"w{i} x{i % 7}" for i in range(4000))
    docs = spark.createDataFrame([(text,)] * 60, "text string").coalesce(1)
    assert 60 * len(text) > 2 * lm_score.POSITION_BYTES
    counts = {o: lm_score._joint(np.zeros((2, 1 << 10), np.uint16)) for o in lm_score.ORDERS}
    mixer, sizes = lm_score.Mixer({o: 10 for o in lm_score.ORDERS}), []
    learn = mixer.learn
    monkeypatch.setattr(mixer, "learn", lambda counts, code, word, times: (sizes.append(len(code)), learn(counts, code, word, times)))
    lm_score.learn_texts(mixer, counts, iter(docs.toArrow().to_batches()))
    code, word, _ = lm_score.positions(whole(text.encode()))
    assert sum(sizes) == len({*zip(code.tolist(), word.tolist(), strict=True)})
    assert mixer.seen[0].sum() == pytest.approx(60 * 8 * len(code))


def test_what_scoring_looks_up_is_made_once(monkeypatch):
    """Evaluations share the final probabilities until something is learned; then those of the new weights are used."""
    bits = {o: 10 for o in lm_score.ORDERS}
    counts = {o: np.random.default_rng(o).integers(0, 40, (2, 1 << 10)).astype(np.uint16) for o in lm_score.ORDERS}
    mixer, made = lm_score.Mixer(bits, {o: lm_score._pack(c) for o, c in counts.items()}), []
    final = mixer.final
    monkeypatch.setattr(mixer, "final", lambda: made.append(0) or final())
    code, word, _ = lm_score.positions(whole(b"the alpha beta " * 30))
    cache = lm_score.Cache(mixer)
    for at in range(0, len(code), 10):
        cache.logs(code[at : at + 10], word[at : at + 10])
    assert len(made) == 1
    before = mixer.logs(code, word)
    mixer.learn(counts, code, word)
    assert not np.allclose(mixer.logs(code, word), before) and len(made) == 2


def test_base_scores_against_plain_counts():
    """Words of long texts, at ends of sections, and beyond HEAD_BYTES; the end among the frequent tokens or not."""
    long = b"q" * (lm_score.HEAD_BYTES + 1)
    texts = [b"", b"  A b\t\ta \n", b"x", b" \x0b\x0c\r", "é É ñ y\x85 \x1c a\x1fb".encode(), long + b" b", b"a " * 700_000 + b"Z" * 1_500_000 + b" w", b"\x00 \xff\xfe a"]
    every = {b"a": -1.0, b"b": -2.0, b"\n": -0.5, lm_score._key(long): -3.0}
    for logs in (every, {b"a": -1.0}, {}):
        n, known, base, rest, times = lm_score.base_scores(texts, logs)
        for i, text in enumerate(texts):
            own = Counter([*re.findall(rb"[^\x20\x09-\x0D]+", text.lower()), b"\n"])
            log = {t: logs.get(t if len(t) <= lm_score.HEAD_BYTES else lm_score._key(t)) for t in own}
            got = Counter()
            for key, k in zip(rest[i].as_py(), times[i].as_py(), strict=True):
                got[key] += k
            others = {lm_score._key(t): k for t, k in own.items() if log[t] is None}
            assert (n[i], known[i], got) == (own.total(), own.total() - sum(others.values()), others)
            assert base[i] == pytest.approx(sum(k * log[t] for t, k in own.items() if log[t] is not None))
