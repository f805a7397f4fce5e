"""Audio features of payloads stored as 8-bit samples.

``store`` puts a payload (UTF-8 bytes, zeros up to a positive multiple of 64) into a WAV container of unsigned 8-bit mono
samples with DataFrame functions only and writes the media table. ``features`` reads the stored bytes back, resamples
16 kHz to 8 kHz by a polyphase filter, takes log-mel energies of overlapped frames and parts the frames by hysteresis of
their energy into segments. Each segment is a tensor of fixed shape (its frames pooled to ``SLICES`` rows of ``MELS``)
with its time span; tensors travel as Arrow IPC with the fixed-shape tensor type.

Each text is worked on alone, in blocks of fixed length, so equal texts give equal values wherever they lie and a very
long one takes bounded memory. Values are rounded to 1/16.

Defined cases: null and empty texts are 64 zero bytes (silence, no segments); very long texts are taken whole; repeated rows
are rows each; of frames as loud as a threshold the upper one starts a segment, the lower one doesn't end it; damaged media
raise ValueError; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, slices, table, tidied

RATE, UP, DOWN = 16_000, 1, 2
WIN, HOP, MELS, SLICES = 256, 128, 24, 8
#: Segments start above the upper and end below the lower share of a text's loudness range.
HIGH, LOW = 0.6, 0.4
#: Frames of a block.
BLOCK = 4096


def _le32(c: Column) -> Column:
    h = F.lpad(F.hex(c), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def wav_of(text: Column) -> tuple[Column, Column]:
    """(unpadded bytes, WAV) of a text."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(raw)
    size = F.greatest(F.lit(64), F.ceil(n / 64) * 64).cast("long")
    head = F.concat(
        F.unhex(F.lit(b"RIFF".hex())), _le32(size + 36), F.unhex(F.lit((b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data").hex())), _le32(size)
    )
    return n.cast("long"), F.concat(head, raw, F.unhex(F.repeat(F.lit("00"), (size - n).cast("int"))))


def samples_of(media: bytes) -> np.ndarray:
    """The samples of a mono 8-bit WAV."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a WAV")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if fmt is None or (fmt[0], fmt[1], fmt[5]) != (1, 1, 8) or at + 8 + size > len(media):
                raise ValueError("not mono 8-bit samples")
            return np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter() -> np.ndarray:
    half = 10 * max(UP, DOWN)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(UP, DOWN)) * np.kaiser(2 * half + 1, 5.0)
    return (h / h.sum() * UP).astype(np.float32)


_H = _filter()


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: out[m] = sum of h[k] * x[(m * DOWN - k) / UP], one branch of the filter for each phase."""
    half = len(_H) // 2
    n = -(-len(x) * UP // DOWN)
    out = np.zeros(n, np.float32)
    for phase in range(UP):
        m = np.arange(phase, n, UP)  # outputs whose filter branch is the same
        branch = _H[(m[0] * DOWN + half) % UP :: UP] if len(m) else _H[:0]
        first = (m * DOWN + half) // UP
        pad = np.concatenate([np.zeros(len(branch), np.float32), x, np.zeros(len(branch) + half + 1, np.float32)])
        step = DOWN  # outputs of a phase lie DOWN inputs apart
        acc = np.zeros(len(m), np.float32)
        base = int(first[0]) + len(branch) if len(m) else 0
        for j, c in enumerate(branch):
            a = base - j
            acc += c * pad[a : a + step * len(m) : step][: len(m)]
        out[phase::UP] = acc
    return out


def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(WIN // 2 + 1) * rate / WIN
    up = (f[:, None] - edge[None, :-2]) / np.diff(edge)[None, :-1]
    down = (edge[None, 2:] - f[:, None]) / np.diff(edge)[None, 1:]
    return np.maximum(0, np.minimum(up, down))


_MEL, _HANN = _mel(), np.hanning(WIN + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Rounded log-mel energies (frames, MELS) of unsigned 8-bit samples, block by block."""
    n = -(-len(x) * UP // DOWN)
    frames = max(1, -(-(n - WIN) // HOP) + 1)
    edge = 64 * DOWN  # beyond the filter's reach
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, BLOCK):
        b = min(frames, a + BLOCK)
        lo, hi = a * HOP * DOWN // UP, ((b - 1) * HOP + WIN) * DOWN // UP
        start = max(0, lo - edge)
        y = resample((x[start : hi + edge].astype(np.float32) - 128) / 128)
        y = y[(lo - start) * UP // DOWN :][: (b - 1 - a) * HOP + WIN]
        y = np.concatenate([y, np.zeros((b - 1 - a) * HOP + WIN - len(y), np.float32)])
        f = np.lib.stride_tricks.sliding_window_view(y, WIN)[::HOP] * _HANN
        p = np.fft.rfft(f, axis=1)
        out[a:b] = np.round(16 * np.log10((p.real**2 + p.imag**2) @ _MEL + 1e-6)) / 16
    return out


def segments(loud: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin above the upper threshold and last until below the lower one."""
    low, high = float(loud.min()), float(loud.max())
    if high - low < 0.25:
        return []
    mark = np.where(loud >= low + HIGH * (high - low), 1, np.where(loud < low + LOW * (high - low), 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0) == 1
    d = np.diff(on.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (SLICES, MELS))


def tensors(x: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    """(time spans in ms, tensors of the segments, frames) of samples."""
    m = log_mel(x)
    spans = segments(m.mean(1))
    out = np.zeros((len(spans), SLICES, MELS), np.float32)
    if spans:
        total = np.concatenate([np.zeros((1, MELS)), np.cumsum(m, axis=0, dtype=np.float64)])
        s = np.array(spans)
        cut = s[:, :1] + (s[:, 1:] - s[:, :1]) * np.arange(SLICES + 1) // SLICES
        lo, hi = cut[:, :-1], np.maximum(cut[:, 1:], cut[:, :-1] + 1)
        out = (np.round(16 * (total[hi] - total[lo]) / (hi - lo)[:, :, None]) / 16).astype(np.float32)
    ms = lambda f: f * HOP * DOWN * 1000 // (UP * RATE)
    return [(ms(a), ms(b - 1) + WIN * DOWN * 1000 // (UP * RATE)) for a, b in spans], out, len(m)


def to_ipc(spans: list[tuple[int, int]], x: np.ndarray) -> bytes:
    """Spans and tensors as an Arrow stream."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), SLICES * MELS)
    t = pa.ExtensionArray.from_storage(TENSOR, flat)
    batch = pa.record_batch([pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), t], names=["start_ms", "stop_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def store(docs: DataFrame) -> DataFrame:
    """The media table (doc_id, n_bytes, media), written to the shared folder."""
    n, wav = wav_of(F.col("text"))
    return table(docs.select("doc_id", n.alias("n_bytes"), wav.alias("media")), "media")[0]


_FIELDS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "tensors"]


@tidied
def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        rows = []
        for view in b.column(2):
            media = view.as_py()
            x = samples_of(media)
            spans, t, frames = tensors(x)
            rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(media), hashlib.sha256(media).hexdigest(), frames, len(spans), to_ipc(spans, t)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=_FIELDS)


def features(media: DataFrame) -> DataFrame:
    """Rows doc_id, n_bytes, digests of what was read back, frames, segments, tensors (Arrow stream with time spans)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments long, tensors binary")


def store_features(media: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The features as a table of the shared folder; ``tensors`` holds the fixed-shape tensors of each row with their time spans."""
    out, path = table(features(media), "features")
    if keep is not None:
        keep.append(path)
    return out


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as samples and read back; a digest of their features as the table of features has them."""
    with scratch(spark) as keep:
        f = store_features(store(documents(spark, sf_dir)), keep)
    feature = F.concat_ws(":", "frames", "segments", F.sha2("tensors", 256))
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op3_audio": op3_audio}
ORACLE_SQL: dict[str, str] = {}
