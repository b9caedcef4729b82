"""Audio features of media columns.

Media are mono 8-bit PCM in RIFF/WAVE containers.  A clip is resampled by a
polyphase windowed-sinc filter, cut into overlapping frames for a log-mel
filterbank, and segmented where the frames' energy passes a high threshold,
until it falls below a low one (hysteresis).  Features are stored as Arrow tensors
of one fixed shape: `FRAMES` x `MELS`, one tensor for every `FRAMES` frames,
the last padded with the floor, each with its time span.

A null clip is read as one without samples: no tensors, no segments.  Each row
is handled alone with array shapes that its bytes alone fix, so equal bytes give equal
values wherever they stand; extra columns have no effect.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.util import map_columns, texts_of

RATE = 8000
PADDING = 64
FRAMES, MELS = 32, 16


@dataclass(frozen=True)
class Params:
    """Resampling by up/down, frame and hop in resampled samples, FFT size, and thresholds of segments in dB below the clip's loudest frame."""

    up: int = 3
    down: int = 4
    half_taps: int = 8
    frame: int = 128
    hop: int = 64
    fft: int = 128
    high_db: float = 3.0
    low_db: float = 6.0
    floor: float = 1e-6


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text with bytes 0 up to a positive multiple of 64; also their number without these."""
    data = (text or "").encode()
    size = max(PADDING, -(-len(data) // PADDING) * PADDING)
    return len(data), data.ljust(size, b"\0")


def write_wave(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE with unsigned 8-bit mono samples."""
    body = samples + b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(body), b"WAVE") + head + body


def read_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a RIFF/WAVE clip with 8-bit mono samples; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE clip")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def phases(up: int, down: int, half_taps: int) -> np.ndarray:
    """The low-pass filter as one row of taps for each output phase."""
    cutoff = 1.0 / max(up, down)
    n = np.arange(-half_taps * up, half_taps * up + 1)
    taps = np.sinc(n * cutoff) * np.hamming(len(n)) * cutoff * up
    width = 2 * half_taps + 1
    out = np.zeros((up, width))
    for phase in range(up):
        own = taps[phase::up]
        out[phase, : len(own)] = own
    return (out / out.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, half_taps: int) -> np.ndarray:
    """x at up/down of its rate: each output sample takes only its phase's taps and the input samples below them."""
    table = phases(up, down, half_taps)
    width = table.shape[1]
    padded = np.concatenate([np.zeros(width // 2, np.float32), x.astype(np.float32), np.zeros(width, np.float32)])
    count = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.zeros(count, np.float32)
    for r in range(min(up, count)):  # every up-th output sample has one phase, and windows `down` apart
        first, phase = divmod(r * down, up)
        own = windows[first::down][: -(-(count - r) // up)]
        for k in range(width):  # tap by tap: sums in one order for every length
            out[r::up] += own[:, k] * table[phase, width - 1 - k]
    return out


@functools.cache
def mel_bank(rate: float, fft: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the FFT's bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - left) / (centre - left), (right - bins) / (right - centre)))
    empty = bank.sum(axis=1) == 0  # narrower than a bin: the nearest one
    bank[empty, np.rint(centre[empty, 0] * fft / rate).astype(int)] = 1
    return bank.T.astype(np.float32)


def log_mel(x: np.ndarray, rate: float, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energies of overlapping frames; the last frame is padded with zeros."""
    count = max(1, -(-(len(x) - p.frame) // p.hop) + 1) if len(x) else 0
    if not count:
        return np.zeros((0, MELS), np.float32), np.zeros(0, np.float32)
    padded = np.zeros((count - 1) * p.hop + p.frame, np.float32)
    padded[: len(x)] = x
    out, energy = [], []
    for k in range(0, count, 1024):  # blocks keep memory even; every block but the last has one shape
        frames = np.lib.stride_tricks.sliding_window_view(padded, p.frame)[:: p.hop][k : k + 1024] * np.hanning(p.frame).astype(np.float32)
        power = np.abs(np.fft.rfft(frames, p.fft)) ** 2
        out.append(np.log(power.astype(np.float32) @ mel_bank(rate, p.fft, MELS) + p.floor))
        energy.append(10 * np.log10((frames * frames).mean(axis=1) + p.floor))
    return np.concatenate(out), np.concatenate(energy)


def segments(energy: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Spans of frames: each holds a frame above the high threshold and all around it above the low one."""
    if not len(energy):
        return []
    top = energy.max()
    above = np.concatenate([[0], (energy >= top - p.low_db).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(above) == 1), np.flatnonzero(np.diff(above) == -1)
    strong = np.concatenate([[0], np.cumsum(energy >= top - p.high_db)])
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if strong[b] > strong[a]]


@dataclass
class Features:
    mel: np.ndarray
    segments: list[tuple[float, float]]
    tensors: np.ndarray
    spans: list[tuple[float, float]]


def analyse(samples: bytes, rate: int, p: Params = Params()) -> Features:
    """All features of one clip."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y, new_rate = resample(x, p.up, p.down, p.half_taps), rate * p.up / p.down
    mel, energy = log_mel(y, new_rate, p)
    seconds = lambda f: f * p.hop / new_rate
    found = [(seconds(a), seconds(b - 1) + p.frame / new_rate) for a, b in segments(energy, p)]
    count = -(-len(mel) // FRAMES)
    tensors = np.full((count * FRAMES, MELS), np.log(p.floor), np.float32)
    tensors[: len(mel)] = mel
    spans = [(seconds(k * FRAMES), seconds(min(len(mel), (k + 1) * FRAMES) - 1) + p.frame / new_rate) for k in range(count)]
    return Features(mel, found, tensors.reshape(count, FRAMES, MELS), spans)


def pack(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream with the blocks of `FRAMES` x `MELS` as a fixed-shape tensor array, and their time spans."""
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)) if len(tensors) else pa.ExtensionArray.from_storage(_TENSOR, pa.array([], _TENSOR.storage_type))
    times = [pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1)]
    batch = pa.RecordBatch.from_arrays([array, *times], schema=_STORED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STORED) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensors and spans of such a stream; the shape is read from its type."""
    with pa.ipc.open_stream(data) as reader:
        batch = reader.read_next_batch()
    array = batch.column(0)
    tensors = array.to_numpy_ndarray() if len(array) else np.zeros((0, *array.type.shape), np.float32)
    return tensors, list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
_STORED = pa.schema([("tensor", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])
_SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def extract(df: DataFrame, media: str = "media", p: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """Adds `tensors` (binary: an Arrow stream of fixed-shape tensors with their time spans, see `unpack`) and `segments` (seconds)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        tensors, found = [], []
        for clip in batch.column(0).to_pylist():
            f = analyse(*read_wave(clip), p) if clip is not None else analyse(b"", RATE, p)
            tensors.append(pack(f.tensors, f.spans))
            found.append([{"start_s": a, "end_s": b} for a, b in f.segments])
        return [pa.array(tensors, pa.binary()), pa.array(found, pa.list_(_SPAN))]

    return map_columns(df, [media], run, "tensors binary, segments array<struct<start_s:double,end_s:double>>", keep)


def store(df: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Adds `media` (binary): the text's padded bytes as the samples of a clip."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([write_wave(payload_of(t)[1]) for t in texts_of(batch, 0)], pa.binary())]

    return map_columns(df, [text], run, f"`{media}` binary", keep)


def _digest(values: np.ndarray) -> str:
    return hashlib.sha256(values.tobytes()).hexdigest()[:16]


def _spans_digest(spans: list[tuple[float, float]]) -> str:
    return _digest(np.rint(np.array(spans, dtype=np.float64) * 1000).astype("<i8"))


def feature_text(tensors: np.ndarray, spans: list[tuple[float, float]], found: list[tuple[float, float]]) -> str:
    """A short form of stored features: shape and digest of the tensors (hundredths) and of their spans (milliseconds), mean row in tenths, number and digest of segments."""
    mean = np.rint(tensors.astype(np.float64).mean(axis=(0, 1)) * 10).astype(int).tolist() if len(tensors) else []
    values = np.rint(tensors.astype(np.float64) * 100).astype("<i4")
    shape = "x".join(map(str, tensors.shape))
    return f"tensors={shape}:{_digest(values)} spans={_spans_digest(spans)} mel={','.join(map(str, mean))} segments={len(found)}:{_spans_digest(found)}"


def round_trip(df: DataFrame, text: str = "text", p: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """Stores each text as a clip, reads it back and adds the digests of what was stored, read and computed; features are those of the stored tensors, read back."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for t in texts_of(batch, 0):
            n_bytes, payload = payload_of(t)
            media = write_wave(payload)
            samples, rate = read_wave(media)
            f = analyse(samples, rate, p)
            tensors, spans = unpack(pack(f.tensors, f.spans))
            rows.append((n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PADDING:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(tensors, spans, f.segments)))
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    return map_columns(df, [text], run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", keep)
