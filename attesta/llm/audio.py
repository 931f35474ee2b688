"""Media columns: audio stored as WAV bytes, with log-mel features of its energetic segments.

A waveform is resampled by a polyphase filter, cut into overlapped frames, and turned into log-mel bands; a
hysteresis on frame energy finds segments. Every segment is a time span and a tensor of fixed shape (``PARTS`` x
``BANDS``); both are stored in Arrow files, the tensors as Arrow's fixed-shape tensor type.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, new_path, written

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 12
WINDOW, HOP, BANDS, PARTS = 256, 128, 20, 8
#: Decibels over the median frame that open a segment, and under which it closes again.
OPEN_DB, CLOSE_DB = 1.5, 0.0
BLOCK, PAD = 576, 255
TENSOR = pa.fixed_shape_tensor(pa.float32(), [PARTS, BANDS])


def padded(data: bytes, block: int = BLOCK, fill: int = PAD) -> bytes:
    """``data`` and as many ``fill`` bytes as make a positive multiple of ``block``."""
    return data + bytes([fill]) * (max(1, -(-len(data) // block)) * block - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file; an odd number of samples is padded as RIFF asks."""
    size = len(samples)
    pad = b"\0" * (size % 2)
    return b"RIFF" + struct.pack("<I", 36 + size + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", size) + samples + pad


def from_wav(data: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono is asked for")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed sinc low-pass, split into one row of taps per output phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up / down: each output sample takes the taps of its phase only, nothing is upsampled."""
    rows = _phases(up, down, taps)
    n = -(-len(x) * up // down)
    x = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(down + 1, np.float32)])
    y = np.zeros(n, np.float32)
    for first in range(min(up, n)):
        phase, base = first * down % up, first * down // up
        count = len(range(first, n, up))
        part = np.zeros(count, np.float32)
        for k in range(taps):
            part += rows[phase, k] * x[base + k : base + k + (count - 1) * down + 1 : down]
        y[first::up] = part
    return y


@lru_cache(8)
def mel_bank(rate: float, window: int = WINDOW, bands: int = BANDS) -> np.ndarray:
    """Triangular filters (bins x bands), equally spaced on the mel scale from 50 Hz to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands (frames x bands) and energies in decibels; a signal shorter than a window is filled up with silence."""
    if len(y) < WINDOW:
        y = np.concatenate([y, np.zeros(WINDOW - len(y), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    shape = np.hanning(WINDOW).astype(np.float32)
    mels, energy = [], []
    for at in range(0, len(view), 8192):
        frames = view[at : at + 8192]
        spectrum = np.fft.rfft(frames * shape, axis=1)
        mels.append(np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel_bank(rate) + 1e-6))
        energy.append(10 * np.log10((frames.astype(np.float64) ** 2).mean(1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def energetic(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Frame spans that begin at ``high`` or more and last until the energy falls below ``low``."""
    mark = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def features(samples: bytes, rate: int = RATE) -> list[tuple[float, float, np.ndarray]]:
    """Segments ``(start_ms, end_ms, tensor)`` of a waveform of unsigned 8-bit samples.

    A waveform without a segment (silence, or even energy) gets one that spans all of it; an empty one gets none.
    """
    if not samples:
        return []
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resampled(x)
    new_rate = rate * UP / DOWN
    mel, energy = log_mel(y, new_rate)
    middle = float(np.median(energy))
    out = []
    for a, b in energetic(energy, middle + OPEN_DB, middle + CLOSE_DB) or [(0, len(mel))]:
        at = a + (np.arange(PARTS + 1) * (b - a)) // PARTS
        sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel[a:b], axis=0, dtype=np.float64)])
        lo, hi = at[:-1] - a, np.maximum(at[1:], at[:-1] + 1) - a
        hi = np.minimum(hi, b - a)
        lo = np.minimum(lo, hi - 1)
        tensor = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
        out.append((a * HOP * 1000 / new_rate, ((b - 1) * HOP + WINDOW) * 1000 / new_rate, tensor.astype(np.float32)))
    return out


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes (none for null), padded to whole blocks, as a WAV file."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw = [(t or b"") for t in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: One segment as it is stored: its time span and its tensor.
SEGMENT = pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("mel", TENSOR)])
STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segments", pa.list_(SEGMENT)),
])


def segment_lists(spans: list[list[tuple[float, float, np.ndarray]] | None]) -> pa.ListArray:
    """Lists of ``SEGMENT`` values; the tensors of all lists lie in one fixed-shape tensor array."""
    every = [x for s in spans for x in s or ()]
    tensors = np.stack([t for _, _, t in every]) if every else np.zeros((0, PARTS, BANDS), np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), PARTS * BANDS)
    rows = pa.StructArray.from_arrays(
        [pa.array([a for a, _, _ in every], pa.float64()), pa.array([b for _, b, _ in every], pa.float64()), pa.ExtensionArray.from_storage(TENSOR, storage)], fields=list(SEGMENT)
    )
    ends = np.concatenate([[0], np.cumsum([len(s or ()) for s in spans])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rows, type=pa.list_(SEGMENT), mask=pa.array([s is None for s in spans], pa.bool_()))


def write_features(media: DataFrame, path: str) -> DataFrame:
    """Reads back ``media (doc_id, n_bytes, media)``, writes ``STORED`` rows to Arrow files under ``path``; returns the manifest ``(path, docs)``.

    A null media gives nulls. A file is written under a name of its attempt and then renamed, so a task that runs again
    leaves one whole file; a task without rows writes none. The manifest is a written table.
    """
    from pyarrow import fs

    bound_batches(media.sparkSession)

    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{task.partitionId():06d}.arrow"
        attempt, out, writer, docs = f"{name}.{task.taskAttemptId()}", None, None, 0
        for batch in batches:
            rows, spans = [], []
            for data in batch.column("media"):
                data = data.as_py()
                if data is None:
                    rows.append((None,) * 5)
                    spans.append(None)
                    continue
                payload, rate = from_wav(data)
                spans.append(features(payload, rate))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()))
            if not rows:
                continue
            if writer is None:
                out = store.open_output_stream(attempt)
                writer = pa.ipc.new_file(out, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(STORED)[2:])]
            writer.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols, segment_lists(spans)], schema=STORED))
            docs += len(rows)
        if writer is not None:
            writer.close()
            out.close()
            store.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "docs": [docs]}, schema=pa.schema([("path", pa.string()), ("docs", pa.int64())]))

    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(run, "path string, docs long"), "tensor-manifest")[0]


def stored_rows(source) -> Iterator[pa.RecordBatch]:
    """Record batches of one file, with the tensor type in place."""
    with pa.ipc.open_file(source) as f:
        for i in range(f.num_record_batches):
            yield f.get_batch(i)


def tensors_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """Starts, ends and tensors (segments x parts x bands) of each row; None for null."""
    lists = batch.column("segments")
    rows = lists.values
    start, end = (rows.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    mel = rows.field(2).to_numpy_ndarray() if len(rows) else np.zeros((0, PARTS, BANDS), np.float32)
    cuts, none = lists.offsets.to_numpy(), lists.is_null().to_pylist()
    return [None if n else (start[a:b], end[a:b], mel[a:b]) for n, a, b in zip(none, cuts[:-1].tolist(), cuts[1:].tolist())]


def feature_text(start: np.ndarray, end: np.ndarray, mel: np.ndarray) -> str:
    """Number of segments, their whole span in ms, and a digest of spans and tensors rounded to two decimals."""
    spans = np.rint(np.stack([start, end], 1) * 10).astype("<i8")
    return f"{len(start)}:{(end - start).sum():.1f}:{hashlib.sha256(spans.tobytes() + np.rint(mel * 100).astype('<i4').tobytes()).hexdigest()}"


def read_features(spark: SparkSession, manifest: DataFrame, base: str) -> DataFrame:
    """What the files of a manifest hold, with ``feature``, a digest of the stored tensors, and their number ``n_segments``."""
    from pyarrow import fs

    files = manifest.count()
    names = [f.name for f in STORED][:-1]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.FileSystem.from_uri(base)[0].open_input_file(path) as source:
                    for rows in stored_rows(source):
                        found = tensors_of(rows)
                        text = pa.array([None if t is None else feature_text(*t) for t in found], pa.string())
                        count = pa.array([None if t is None else len(t[0]) for t in found], pa.int64())
                        yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], text, count], names=[*names, "feature", "n_segments"])

    return manifest.select("path").repartition(max(1, files)).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long"
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text's media and then its features in the shared folder, and returns what ``read_features`` reads back."""
    spark = docs.sparkSession
    media, kept = written(stored(docs), "media")
    path = new_path(spark, "tensors")
    manifest = write_features(media, path)
    drop_path(spark, kept)
    return read_features(spark, manifest, path)
