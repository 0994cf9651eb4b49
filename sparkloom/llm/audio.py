"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segmentation.

A payload is stored as mono 8-bit WAV. Its samples are resampled to UP / DOWN of their rate by a polyphase low-pass
filter (UP phases; each output takes the phase of its place between inputs), cut into overlapping windowed
frames, turned into log-mel energies and stored as tensors of one fixed shape (FRAMES x MELS, the last one padded)
in a fixed-shape Arrow tensor array, each with its time span. Hysteresis on frame energy (a segment opens above
the high threshold and closes below the low one) yields the active time spans.

Null and empty texts give a payload of one padded block. Every text is processed whole. Samples are resampled and
transformed in blocks of frames, so beside the payload and its features the work space does not grow with its length.
Equal texts give equal values, repeated rows and null ids included; empty tables give empty results; other columns do not matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, small_batches, text_slices

#: 16,000 samples a second become 12,000.
RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, MELS, FRAMES = 256, 128, 32, 64
BLOCK = 576
#: Frames that are made at once.
STEP = 1_024
#: Above HIGH times the mean frame energy a segment opens, below LOW times it closes.
HIGH, LOW = 1.25, 0.9
_MADE: dict = {}


def pad_payload(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc filter at ``up`` times the input's rate, 2 * taps * up coefficients."""
    n = 2 * taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    return h * up / h.sum()


def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The filter's ``up`` phases of 2 * taps coefficients each: those that meet inputs when an output lies that far behind one."""
    key = ("phases", up, down, taps)
    if key not in _MADE:
        _MADE[key] = low_pass(up, down, taps).reshape(2 * taps, up).T[:, ::-1].astype(np.float32)
    return _MADE[key]


def resampled_size(n: int, up: int = UP, down: int = DOWN) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Outputs [lo, hi) of ``x`` at ``up / down`` times its rate: output m takes phase (m * down) mod up around input m * down // up."""
    bank = phases(up, down, taps)
    hi = resampled_size(len(x), up, down) if hi is None else hi
    m = np.arange(lo, hi, dtype=np.int64)
    out = np.empty(len(m), np.float32)
    if len(m) == 0:
        return out
    first, last = lo * down // up - taps + 1, (hi - 1) * down // up + taps + 1
    padded = np.zeros(last - first, np.float32)
    a, b = max(0, first), min(len(x), last)
    padded[a - first : max(a, b) - first] = x[a:b]
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
    for r in range(up):
        own = m % up == r
        at = m[own] * down // up - taps + 1 - first
        if len(at):
            out[own] = views[at[0] :: down][: len(at)] @ bank[(r * down) % up]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale: (FRAME // 2 + 1) x MELS."""
    key = ("mel", rate)
    if key not in _MADE:
        top = 2595 * np.log10(1 + rate / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
        freq = np.arange(FRAME // 2 + 1)[:, None] * rate / FRAME
        rise = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2])
        fall = (edges[2:] - freq) / (edges[2:] - edges[1:-1])
        _MADE[key] = np.maximum(0, np.minimum(rise, fall)).astype(np.float32)
        _MADE["window"] = np.hanning(FRAME).astype(np.float32)
    return _MADE[key]


def frame_count(n: int) -> int:
    """Frames of ``n`` samples; the end is padded with zeros."""
    return max(1, -(-max(0, n - FRAME) // HOP) + 1)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies) of overlapping frames of the resampled 8-bit samples, STEP frames at a time."""
    raw = np.frombuffer(samples, np.uint8)
    size = resampled_size(len(raw))
    bank, n = mel_bank(RATE * UP / DOWN), frame_count(size)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, STEP):
        j = min(n, i + STEP)
        lo, hi = i * HOP, (j - 1) * HOP + FRAME
        # The inputs that these outputs reach.
        first = max(0, lo * DOWN // UP - TAPS - DOWN) // DOWN * DOWN
        part = (raw[first : (hi * DOWN // UP) + TAPS + DOWN].astype(np.float32) - 128) / 128
        x = np.zeros(hi - lo, np.float32)
        shift = first // DOWN * UP
        own = resample(part, lo=lo - shift, hi=min(hi, size) - shift)
        x[: len(own)] = own
        views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _MADE["window"]
        power = np.abs(np.fft.rfft(views, axis=1)).astype(np.float32) ** 2
        mels[i:j] = np.log(power @ bank + np.float32(1e-6))
        energy[i:j] = (views * views).mean(axis=1)
    return mels, energy


def hysteresis(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """Segments (first frame, last frame + 1): opened where energy exceeds ``high`` times its mean, closed below ``low`` times it."""
    mean = energy.mean()
    mark = np.where(energy > high * mean, 1, np.where(energy < low * mean, -1, 0))
    mark[0] = mark[0] or -1
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    on = np.concatenate([[0], (mark[last] > 0).astype(np.int8), [0]])
    step = np.diff(on)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def tensors(mels: np.ndarray) -> tuple[pa.FixedShapeTensorArray, np.ndarray]:
    """Fixed-shape Arrow tensors of FRAMES x MELS with their time spans in seconds; the last is padded with zeros."""
    n = -(-len(mels) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float32)
    full[: len(mels)] = np.round(mels, 3)
    first = np.arange(n) * FRAMES
    spans = np.stack([first * HOP, (np.minimum(first + FRAMES, len(mels)) - 1) * HOP + FRAME], axis=1) / (RATE * UP / DOWN)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, MELS)), spans


def features(samples: bytes) -> tuple[pa.FixedShapeTensorArray, np.ndarray, np.ndarray, int]:
    """(tensors, their time spans, active segments in seconds, number of frames) of 8-bit samples."""
    mels, energy = log_mel(samples)
    # A segment of frames lasts from its first frame's start to its last frame's end.
    found = hysteresis(energy)
    active = np.stack([found[:, 0] * HOP, (found[:, 1] - 1) * HOP + FRAME], axis=1) / (RATE * UP / DOWN)
    return (*tensors(mels), active, len(mels))


def tensor_stream(array: pa.FixedShapeTensorArray, spans: np.ndarray) -> bytes:
    """Arrow IPC stream of a table (tensor, start_s, end_s)."""
    table = pa.table({"tensor": array, "start_s": spans[:, 0], "end_s": spans[:, 1]})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue()


def audio_columns(docs: DataFrame, keep_tensors: bool = False) -> DataFrame:
    """Media digest, time spans and features of every whole text.

    ``tensor_spans`` and ``segments`` are the time spans of the tensors and of the active segments, in seconds.
    With ``keep_tensors``: the WAV bytes, and the tensors with their time spans as an Arrow IPC stream.
    """
    small_batches(docs.sparkSession)
    span = "array<struct<start_s:double,end_s:double>>"
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_spans {span}, segments {span}"
    if keep_tensors:
        schema += ", media binary, tensors binary"
    listed = lambda x: [{"start_s": a, "end_s": b} for a, b in x.tolist()]

    def row(data: bytes) -> tuple:
        media = to_wav(pad_payload(data))
        back = from_wav(media)
        array, spans, segments, n = features(back)
        digest = hashlib.sha256(np.ascontiguousarray(array.to_numpy_ndarray()).tobytes())
        digest.update(spans.tobytes() + segments.tobytes())
        out = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{n}:{len(array)}:{len(segments)}:{digest.hexdigest()[:32]}", listed(spans), listed(segments))
        return out + (media, tensor_stream(array, spans)) * keep_tensors

    names = [x.split()[0] for x in schema.split(", ")]
    spans_ = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_, spans_, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = zip(*map(row, as_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
