"""Media columns: documents' bytes as 8-bit audio, read back and described by features.

A payload is stored as a one-channel WAV stream of unsigned 8-bit samples. The
features of a stream are computed from its stored samples alone: polyphase
resampling by UP / DOWN, log-mel energies of overlapped frames, and segments
of activity by a hysteresis threshold on frame energy, with their time spans.
Log-mel energies are cut into tiles of a fixed shape, each with its time span,
and stored as Arrow's fixed-shape tensors: a binary column holds an Arrow stream with one row a tile, whose
extension type any reader of Arrow restores. Segments are an array of time spans. What a row says of its
media is derived from these stored columns.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import pieces, raw, table

#: The stream's sample rate, resampling factors, frame and hop in samples after resampling, mel bands, frames of a tile.
RATE, UP, DOWN, FRAME, HOP, BANDS, TILE = 8000, 2, 3, 256, 160, 24, 32
#: Taps of the resampling filter for each of its phases, and frames handled at once.
TAPS, BLOCK_FRAMES = 16, 8192
#: The least log-mel energy, which also pads the last tile.
FLOOR = -6
#: Payloads are padded to a positive multiple of this.
UNIT = 64
#: A segment opens above the first and closes below the second factor of the stream's mean frame energy.
OPEN, CLOSE = 1.15, 0.95


def payload(data: bytes) -> bytes:
    """data with zero bytes appended up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def encode(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV stream that holds samples losslessly, one 8-bit sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def decode(stream: bytes) -> tuple[bytes, int]:
    """The stored samples and their rate."""
    with wave.open(io.BytesIO(stream), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=8)
def _filter(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of TAPS taps for each of the up phases."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, up).T.astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up/down: each output sample takes one phase's taps, in blocks."""
    phases = _filter(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(1, np.float32)])
    out = np.empty(n, np.float32)
    for phase in range(up):
        first = next((i for i in range(up) if i * down % up == phase), None)
        if first is None:
            continue
        where = np.arange(first, n, up)
        base = where * down // up
        for at in range(0, len(where), 1 << 16):
            b = base[at : at + (1 << 16)]
            acc = np.zeros(len(b), np.float32)
            for k in range(TAPS):
                acc += phases[phase, k] * padded[b + (TAPS - 1 - k)]
            out[where[at : at + (1 << 16)]] = acc
    return out


@lru_cache(maxsize=8)
def _mel(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular mel filters over the frame's spectrum, frame / 2 + 1 rows by bands."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache(maxsize=2)
def _window(frame: int = FRAME) -> np.ndarray:
    return np.hanning(frame + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, float]:
    """Of 8-bit samples: log-mel energies (frames, BANDS), frame energies, seconds a hop. Short streams are padded to a frame."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    new_rate = rate * UP / DOWN
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    n = 1 + (len(y) - FRAME) // HOP
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[:: HOP][:n]
    mels, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        block = view[at : at + BLOCK_FRAMES] * _window()
        power = np.abs(np.fft.rfft(block, axis=1)).astype(np.float32) ** 2
        mels[at : at + BLOCK_FRAMES] = np.log10(power @ _mel(new_rate) + 10.0**FLOOR)
        energy[at : at + BLOCK_FRAMES] = (block * block).mean(axis=1)
    return mels, energy, HOP / new_rate


def segments(energy: np.ndarray, hop: float) -> list[tuple[float, float]]:
    """Time spans of activity: opened by a frame above OPEN, closed by the next below CLOSE times the mean energy."""
    mean = float(energy.mean()) if len(energy) else 0.0
    event = np.where(energy > OPEN * mean, 1, np.where(energy < CLOSE * mean, -1, 0))
    at = np.flatnonzero(event)
    state = np.repeat(event[at], np.diff(np.append(at, len(event)))) if len(at) else np.empty(0, int)
    state = np.concatenate([np.full(len(event) - len(state), -1), state])
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], state, [-1]])))
    return [(float(a * hop), float(b * hop)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tile_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (TILE, BANDS), dim_names=["frame", "band"])


def write_tiles(mels: np.ndarray, hop: float) -> bytes:
    """An Arrow stream of tiles: (start_s, end_s, frames, mel), mel a tensor of TILE frames by BANDS.

    The last tile is padded with the floor value; frames says how many of its frames are the stream's.
    """
    n = -(-len(mels) // TILE)
    full = np.full((n * TILE, BANDS), FLOOR, np.float32)
    full[: len(mels)] = mels
    starts, ends = np.arange(n) * TILE, np.minimum((np.arange(n) + 1) * TILE, len(mels))
    tensors = pa.ExtensionArray.from_storage(tile_type(), pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TILE * BANDS))
    batch = pa.RecordBatch.from_arrays([pa.array(starts * hop), pa.array(ends * hop), pa.array(ends - starts, pa.int32()), tensors], names=["start_s", "end_s", "frames", "mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def read_tiles(stored: bytes) -> pa.Table:
    """The tiles of write_tiles(); their column mel has the fixed-shape tensor type."""
    return pa.ipc.open_stream(pa.py_buffer(stored)).read_all()


def feature_digest(tiles: bytes, spans: list[tuple[float, float]], seconds: float) -> str:
    """The feature string, from the stored tiles and segments."""
    table = read_tiles(tiles)
    mel = table.column("mel").combine_chunks()
    tensors = (mel if isinstance(mel, pa.Array) else mel.chunk(0)).to_numpy_ndarray()
    frames = table.column("frames").to_numpy()
    mine = tensors[np.arange(TILE) < frames[:, None]].astype(np.float64)
    bands = ",".join(f"{v:.2f}" for v in np.round(mine.mean(axis=0), 2) + 0.0)
    coarse = zlib.crc32(np.rint(tensors * 10).astype("<i2").tobytes())
    return f"frames={frames.sum()};seconds={seconds:.3f};tiles={len(frames)}x{TILE}x{BANDS};tensors={coarse:08x};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};mel={bands}"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a WAV stream in a binary column.

    A null text counts as empty: its payload is UNIT zero bytes. Further columns
    are ignored; repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data = raw(piece)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([encode(payload(x)) for x in data], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


SEGMENT = "struct<start_s:double,end_s:double>"


def analyse_media(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with tiles (binary, see read_tiles) and segments (array of time spans), computed from the streams.

    A null stream has null for both. Equal streams have equal values.
    """

    def one(stream: bytes | None) -> tuple:
        if stream is None:
            return None, None
        samples, rate = decode(stream)
        mels, energy, hop = log_mel(samples, rate)
        return write_tiles(mels, hop), [{"start_s": a, "end_s": b} for a, b in segments(energy, hop)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for piece in pieces(batches, "media"):
            found = [one(x) for x in piece.column("media").to_pylist()]
            columns = [*(piece.column(c) for c in ("doc_id", "n_bytes", "media")), pa.array([t for t, _ in found], pa.binary()), pa.array([s for _, s in found], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "tiles", "segments"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, tiles binary, segments array<{SEGMENT}>")


def describe_media(analysed: DataFrame) -> DataFrame:
    """Reads the stored columns back: the payload's and the stream's digests, and the feature string of tiles and segments.

    A null stream gives nulls. Equal streams give equal values. An empty table gives an empty one.
    """

    def one(stream: bytes | None, tiles: bytes | None, spans: list | None) -> tuple:
        if stream is None:
            return None, None, None, None, None, None
        samples, rate = decode(stream)
        feature = feature_digest(tiles, [(s["start_s"], s["end_s"]) for s in spans], len(samples) / rate)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media"):
            columns = list(zip(*map(one, *(piece.column(c).to_pylist() for c in ("media", "tiles", "segments"))), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = analysed.schema["doc_id"].dataType.simpleString()
    return analysed.select("doc_id", "n_bytes", "media", "tiles", "segments").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def mel_tiles(analysed: DataFrame) -> DataFrame:
    """(doc_id, tile, start_s, end_s, frames, mel array<float>): the stored tiles one a row, mel flattened by frames. A null stream has no tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "tiles"):
            for doc, stored in zip(piece.column("doc_id"), piece.column("tiles").to_pylist(), strict=True):
                if stored is None:
                    continue
                for tiles in read_tiles(stored).to_batches():
                    n = tiles.num_rows
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * TILE * BANDS)
                    mel = pa.ListArray.from_arrays(offsets, tiles.column("mel").storage.flatten())
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, piece.column("doc_id").type), pa.array(range(n), pa.int64()), *(tiles.column(c) for c in ("start_s", "end_s", "frames")), mel], names=["doc_id", "tile", "start_s", "end_s", "frames", "mel"])

    kind = analysed.schema["doc_id"].dataType.simpleString()
    return analysed.select("doc_id", "tiles").mapInArrow(run, f"doc_id {kind}, tile long, start_s double, end_s double, frames int, mel array<float>")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(analyse_media(store_media(table(spark, sf_dir, "documents", "doc_id", "text"))))
