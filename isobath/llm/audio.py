"""Media columns: audio features of 8-bit samples.

``encode`` stores bytes as a RIFF/WAVE file with 8-bit mono samples in a binary column; ``features``
parses the stored file and computes, from the samples alone: a polyphase resampling to ``TARGET`` Hz by a
windowed sinc, log-mel energies of overlapping Hann frames, and segments by hysteresis: a segment is a
run of frames above the low threshold that reaches the high one, both below the loudest frame. The frames are cut into clips of a fixed
shape and stored as an Arrow stream whose column is a fixed-shape tensor, with each clip's time span and
whether a segment touches it. Frames are computed in blocks, so memory does not follow a file's length,
and document by document, so equal texts have equal values.

Nulls and empty texts: their payload is 64 zero bytes, as padding goes up to a positive multiple of 64. A
stored value that is no such WAVE file gives nulls and an ``error``. Repeated rows are each computed. Extra
columns play no part in the result. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.llm.shared import table

PAD = 64
RATE, TARGET = 11_025, 8_000
FRAME, HOP, MELS = 256, 128, 24
CLIP = 16
HIGH_DB, LOW_DB = -1.5, -4.0
BLOCK_FRAMES = 256
HALF = 8


def to_payload(text: bytes, pad: int = PAD) -> bytes:
    return text.ljust(max(pad, -(-len(text) // pad) * pad), b"\0")


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def from_wave(media: bytes) -> tuple[int, memoryview]:
    """Rate and samples of an 8-bit mono WAVE file; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            if rate is None or at + 8 + n > len(media):
                raise ValueError("cut off")
            return rate, memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


class Resampler:
    """Output sample n is the phase n * down mod up of the filter over the inputs around n * down / up."""

    def __init__(self, rate: int, target: int):
        g = math.gcd(rate, target)
        self.up, self.down = target // g, rate // g
        widest = max(self.up, self.down)
        k = np.arange(-HALF * widest, HALF * widest + 1)
        taps = np.sinc(k / widest) * np.hamming(len(k)) * self.up / widest
        self.reach = HALF * widest // self.up + 1
        phases = []
        for phase in range(self.up):
            # input i at distance d = n * down / up - i meets tap d * up
            d = np.arange(-self.reach, self.reach + 1) * self.up + phase
            inside = np.abs(d) <= HALF * widest
            phases.append(np.where(inside, taps[np.clip(d, k[0], k[-1]) - k[0]], 0.0)[::-1])
        self.phases = np.array(phases)

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def __call__(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Outputs start .. stop of samples x (unsigned bytes), zero outside."""
        first = start * self.down // self.up - self.reach
        last = (stop - 1) * self.down // self.up + self.reach + 1
        part = np.zeros(last - first)
        a, b = max(first, 0), min(last, len(x))
        if b > a:
            part[a - first : b - first] = x[a:b]
            part[a - first : b - first] -= 128.0
            part /= 128.0
        windows = np.lib.stride_tricks.sliding_window_view(part, 2 * self.reach + 1)
        n = np.arange(start, stop) * self.down
        if self.up == 1:
            return windows[n - self.reach - first] @ self.phases[0]
        return np.einsum("ij,ij->i", windows[n // self.up - self.reach - first], self.phases[n % self.up])


def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles that are evenly spaced in mel; (frequencies, mels)."""
    to_mel = lambda f: 2595.0 * np.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595.0) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall))


_HANN = np.hanning(FRAME + 1)[:-1]
_MEL = mel_filters(TARGET)
_RESAMPLERS: dict[int, Resampler] = {}


def log_mel(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) natural-log energies and the frames' level in dB of full scale."""
    if rate not in _RESAMPLERS:
        _RESAMPLERS[rate] = Resampler(rate, TARGET)
    resample = _RESAMPLERS[rate]
    n = resample.length(len(samples))
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    mel, level = np.empty((frames, MELS), np.float32), np.empty(frames)
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(frames, a + BLOCK_FRAMES)
        y = resample(samples, a * HOP, (b - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        spectrum = np.fft.rfft(cut * _HANN, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel[a:b] = np.log(power @ _MEL + 1e-6)
        level[a:b] = 10 * np.log10(np.einsum("ij,ij->i", cut, cut) / FRAME + 1e-10)
    return mel, level


def segments(level: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """(n, 2) first and last + 1 frame of the runs above low that reach high, in dB from the loudest frame."""
    peak = level.max()
    above = np.r_[False, level >= peak + low, False]
    edge = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
    loud = np.r_[0, np.cumsum(level >= peak + high)]
    return edge[loud[edge[:, 1]] > loud[edge[:, 0]]]


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [CLIP, MELS])
_CLIPS = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("active", pa.bool_()), ("log_mel", _TENSOR)])


def to_tensors(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """Clips of CLIP frames (the last one filled with silence) as an Arrow stream."""
    n = -(-len(mel) // CLIP)
    full = np.full((n * CLIP, MELS), np.float32(math.log(1e-6)), np.float32)
    full[: len(mel)] = mel
    touched = np.zeros(n * CLIP + 1, np.int64)
    np.add.at(touched, spans[:, 0], 1)
    np.add.at(touched, spans[:, 1], -1)
    active = (np.cumsum(touched)[:-1] > 0).reshape(n, CLIP).any(axis=1)
    start = np.arange(n) * (CLIP * HOP / TARGET)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), CLIP * MELS)
    batch = pa.record_batch([pa.array(start), pa.array(start + ((CLIP - 1) * HOP + FRAME) / TARGET), pa.array(active), pa.ExtensionArray.from_storage(_TENSOR, storage)], schema=_CLIPS)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, _CLIPS) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def read_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def _batches(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of about most bytes of a column."""
    a, size = 0, 0
    for i, x in enumerate(batch.column(column)):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= most:
            yield batch.slice(a, i + 1 - a)
            a, size = i + 1, 0
    if a < batch.num_rows:
        yield batch.slice(a)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes, padded, as a WAVE file."""

    def run(batches):
        for whole in batches:
            for batch in _batches(whole, "raw"):
                raw = [x or b"" for x in batch.column("raw").to_pylist()]
                yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wave(to_payload(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("feature", pa.string()), ("n_frames", pa.int64()), ("segments", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), ("tensors", pa.binary()), ("error", pa.string()),
    ]
)
_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, segments array<struct<start: double, end: double>>, tensors binary, error string"


def _row(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 9 + ("no media",)
    seen = (len(media), hashlib.sha256(media).hexdigest())
    try:
        rate, samples = from_wave(media)
    except (ValueError, struct.error) as broken:
        return (None, None, None, *seen, None, None, None, None, str(broken))
    mel, level = log_mel(np.frombuffer(samples, np.uint8), rate)
    spans = segments(level)
    times = [{"start": a * HOP / TARGET, "end": ((b - 1) * HOP + FRAME) / TARGET} for a, b in spans.tolist()]
    digest = hashlib.sha256(np.round(mel * 64).astype("<i2").tobytes() + spans.astype("<i8").tobytes()).hexdigest()
    feature = f"frames={len(mel)} segments={len(spans)} mel={digest}"
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), *seen, feature, len(mel), times, to_tensors(mel, spans), None)


def features(media: DataFrame) -> DataFrame:
    """A row of features for each stored file of doc_id, n_bytes, media."""

    def run(batches):
        for whole in batches:
            for batch in _batches(whole, "media", 1 << 20):
                rows = [_row(x.as_py()) for x in batch.column("media")]
                yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_OUT)[2:], strict=True)]], schema=_OUT)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DDL)


def op7_audio_features(spark, sf_dir):
    stored = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", F.size("segments").cast("long").alias("n_segments"), "segments", "tensors")
