import random
import re
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import simhash
from tests.llm import fixtures


def plain_fingerprint(text, words=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    """Least id reachable, for {id: fingerprint}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def check(got, docs):
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs if d["doc_id"] is not None}
    component = plain_components(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fp"] % 2**64, r["component_id"]) == (fps[r["doc_id"]], component[r["doc_id"]])


def test_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(None, "z z z", None, None, None), (4, "two words", "en", "src1", 9)]))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    check(got, docs.collect())
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet").collect()
    got = simhash.op2_simhash(spark, fixtures.SF).collect()
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    component = plain_components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", component[i]) for i in fps}


def test_links_of_clustered_fingerprints_with_split_shards(spark):
    rng, found = random.Random(2), set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(40):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5)))
            found.add(x)
    fps = dict(enumerate(sorted(found)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in fps.items()], "fp long, node long")
    want = plain_components(fps)
    size = Counter(want.values())
    for rows in (16_384, 7):
        got = simhash.connected_components(simhash.links(nodes, tree_rows=rows)).collect()
        assert {i: c for i, c in want.items() if size[c] > 1} == {r["node"]: r["component"] for r in got}


def test_tree_search_equals_scan():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(0, 40, 3)]))
    got = {(n, int(q)) for n, hits in simhash.BkTree(fps).search(fps, 4) for q in hits}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
