import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm import fixtures

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_first_fit_equals_plain_loop():
    rng = random.Random(1)
    sizes = np.array([rng.randrange(1, 101) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= sizes[i]


def check(got, docs, sequence):
    library = Tokenizer.from_file(PATH)
    pieces, layout, texts = defaultdict(list), defaultdict(list), defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(d["text"] or "")
    for r in got:
        pieces[r["doc_id"]].append(r)
        layout[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for doc, all_texts in texts.items():
        want = []
        for text in all_texts:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
            want += [(at, len(x) // 4, zlib.crc32(x), len(ids) // 4) for at in range(0, len(ids) // 4, sequence) for x in [ids[4 * at : 4 * (at + sequence)]]]
        assert sorted(want) == sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc])
    for spans in layout.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(0, None, None, None, None), (None, "z", None, None, None), (3, "word", "en", "src0", 4)]))
    check(packing.pack(docs, PATH, RANKS, 64, group_docs=9).collect(), docs.collect(), 64)
    assert packing.pack(fixtures.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_spaces_of_any_kind(ranks):
    bpe, rng = packing.ByteBpe(PATH, ranks, kept=20), random.Random(5)
    docs = ["".join(rng.choice("ab  \n\t1é!'s \x1c") for _ in range(rng.randrange(40))) for _ in range(600)]
    want = [np.array(bpe.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in docs]
    assert [x for at in range(0, 600, 50) for x in bpe.encode(docs[at : at + 50])] == want


def test_given_documents(spark):
    got = packing.op8_packing(spark, fixtures.SF).collect()
    check(got, spark.read.parquet(f"{fixtures.SF}/documents.parquet").collect(), 1024)
    used = sum(r["length"] for r in got)
    assert used >= 0.97 * 1024 * len({r["sequence_id"] for r in got})
