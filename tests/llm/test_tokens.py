import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokens
from tests.llm import fixtures

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_library(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(0, None, None, None, None), (None, "z", None, None, None)]))
    library = Tokenizer.from_file(PATH)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    got = tokens.count_tokens(docs, PATH, 100).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert tokens.count_tokens(fixtures.empty(spark), PATH).count() == 0


LIBRARY = Tokenizer.from_file(PATH)
ODD = ["'", "'s", "'re", "'ll", "'v", "'r", "'t", "''", "!", "...", " ", "  ", "\n", "\x1c", "\x85", "1", "42", "a", "the", "The", "tokenisation", "é", "ñ", "ß", "İ", "ﬁ", "日本", "語", "Ж", "\u0301", "\u200d", "½", "١", "🙂", "\ud7ff", "x" * 40, "don't", "_", "zq", "I'VE", "rock'n'roll"]


def plain(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_any_chunking_gives_the_same_count():
    t, rng = tokens.Transducer(PATH, states=300), random.Random(3)
    for chunk in (1, 2, 3, 7, 256):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(300)]
        assert t.counts(texts, chunk).tolist() == plain(texts)


def test_every_short_match_and_token():
    t, rng = tokens.Transducer(PATH), random.Random(4)
    vocab = [x.removesuffix("</w>") for x in LIBRARY.get_vocab()]
    texts = rng.sample(vocab, 4000) + [a + b for a, b in zip(rng.sample(vocab, 4000), rng.sample(vocab, 4000), strict=True)]
    texts += ["".join(rng.choice("abehinorst") for _ in range(rng.randrange(25))) for _ in range(2000)]
    assert t.counts(texts).tolist() == plain(texts)


def test_long_words_and_texts():
    t, rng = tokens.Transducer(PATH), random.Random(5)
    texts = ["ab" * 3000, "a" * 5000, "1" * 700, "!" * 700, " ".join("".join(rng.choice("aeioulnst") for _ in range(rng.randrange(1, 12))) for _ in range(20_000)), " " * 1000, "é" * 900 + " " + "日" * 300]
    assert t.counts(texts).tolist() == plain(texts)
    assert t.counts(texts + ["a<|endoftext|>b", "<|EndOfText|>"]).tolist() == plain(texts + ["a<|endoftext|>b", "<|EndOfText|>"])


def test_given_documents(spark):
    library = Tokenizer.from_file(PATH)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{fixtures.SF}/documents.parquet").collect()}
    for r in tokens.op10_tokens(spark, fixtures.SF).collect():
        assert r["n_tokens"] == len(library.encode(text[r["doc_id"]], add_special_tokens=False))
