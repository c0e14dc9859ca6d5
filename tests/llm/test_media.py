import hashlib
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import media
from tests.llm import fixtures


def test_round_trip_of_awkward_rows(spark):
    docs = fixtures.clashing(fixtures.frame(spark, [(0, None, None, None, None), (None, "z", None, None, None)]))
    stored = media.analyse_media(media.store_media(docs))
    got = {(r["doc_id"], r["payload_sha256"], r["tail_crc32"], r["n_bytes"], r["payload_bytes"]) for r in media.describe_media(stored).collect()}
    want = set()
    for d in docs.collect():
        data = (d["text"] or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.add((d["doc_id"], hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(data), len(full)))
    assert got == want
    assert media.describe_media(media.analyse_media(media.store_media(fixtures.empty(spark)))).count() == 0


def test_resampling_equals_plain_sum():
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 1)):
        taps = media._filter(up, down).T.ravel()
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, taps)[: len(stuffed)][::down]
        assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_segments():
    energy = np.array([1, 1, 9, 5, 9, 1, 1, 9, 9, 1], float)
    assert media.segments(energy, 1.0) == [(2.0, 5.0), (7.0, 9.0)]
    assert media.segments(np.zeros(3), 1.0) == []


def test_tone_lands_in_its_band():
    t = np.arange(16000) / 8000
    low, high = (media.log_mel((np.sin(2 * np.pi * f * t) * 100 + 128).astype(np.uint8).tobytes())[0].mean(axis=0).argmax() for f in (300, 1500))
    assert low < high


def test_stored_tiles_are_fixed_shape_tensors(spark):
    docs = fixtures.frame(spark)
    analysed = media.analyse_media(media.store_media(docs)).collect()
    assert len(analysed) == docs.count()
    for r in analysed:
        tiles = media.read_tiles(r["tiles"])
        assert tiles.schema.field("mel").type == media.tile_type()
        tensors = tiles.column("mel").chunk(0).to_numpy_ndarray()
        assert tensors.shape == (tiles.num_rows, media.TILE, media.BANDS)
        samples, rate = media.decode(r["media"])
        mels, energy, hop = media.log_mel(samples, rate)
        flat, n = tensors.reshape(-1, media.BANDS), sum(tiles.column("frames").to_pylist())
        assert n == len(mels) and np.array_equal(flat[:n], mels) and (flat[n:] == media.FLOOR).all()
        assert [(s["start_s"], s["end_s"]) for s in r["segments"]] == media.segments(energy, hop)
        assert all(a < b for a, b in zip(tiles.column("start_s").to_pylist(), tiles.column("end_s").to_pylist(), strict=True))
    rows = media.mel_tiles(media.analyse_media(media.store_media(docs))).collect()
    assert len(rows) == sum(media.read_tiles(r["tiles"]).num_rows for r in analysed) and all(len(r["mel"]) == media.TILE * media.BANDS for r in rows)
    assert media.mel_tiles(media.analyse_media(media.store_media(fixtures.empty(spark)))).count() == 0


def test_null_streams_and_feature_string(spark):
    stored = spark.createDataFrame([(1, None, None), (2, 3, bytearray(media.encode(media.payload(b"abc"))))], "doc_id long, n_bytes long, media binary")
    analysed = media.analyse_media(stored)
    assert media.mel_tiles(analysed).select("doc_id").distinct().collect()[0]["doc_id"] == 2
    got = {r["doc_id"]: r for r in media.describe_media(analysed).collect()}
    assert got[1]["feature"] is None and got[1]["payload_bytes"] is None
    samples = media.payload(b"abc")
    mels, energy, hop = media.log_mel(samples)
    means = mels.astype(float).mean(axis=0)
    name = dict(x.split("=") for x in got[2]["feature"].split(";"))
    assert name["frames"] == str(len(mels)) and name["tiles"] == f"1x{media.TILE}x{media.BANDS}" and name["seconds"] == f"{64 / 8000:.3f}"
    assert [float(x) for x in name["mel"].split(",")] == [round(float(x), 2) + 0.0 for x in means]
    assert name["segments"] == str(len(media.segments(energy, hop)))
