"""Media columns: text bytes as 8-bit audio, and features of the stored bytes.

A payload is stored losslessly as a WAV file of unsigned 8-bit samples.  The
stored bytes are read back, resampled by a polyphase filter, cut into
overlapping frames and turned into log-mel bands; frame energies with two
thresholds (hysteresis) give active segments.  Clips of CLIP frames become
fixed-shape Arrow tensors with their time spans.

Work goes block by block, so a long payload needs no more memory than its own
samples at the lower rate; each row is computed by itself, so equal texts have
equal values wherever they stand.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import byte_view, map_batches

#: Payload bytes come in multiples of this.
ALIGN = 64
STORED_RATE, FEATURE_RATE = 16_000, 10_000
FRAME, HOP, BANDS, CLIP = 256, 128, 20, 64
TAPS = 16
BLOCK_FRAMES = 4096


def to_wav(payload: bytes, rate: int = STORED_RATE) -> bytes:
    """WAV file of one channel of unsigned 8-bit samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of such a file, found by walking its chunks."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit samples of one channel")
        elif name == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


class Resampler:
    """Rational polyphase resampler: one short filter for each output phase."""

    def __init__(self, source: int, target: int, taps: int = TAPS):
        g = gcd(source, target)
        self.up, self.down, self.taps = target // g, source // g, taps
        n = taps * self.up
        t = np.arange(n) - (n - 1) / 2
        cutoff = 1.0 / max(self.up, self.down)
        h = np.sinc(t * cutoff) * np.hamming(n) * cutoff * self.up
        # filter of phase p: every up-th tap, newest sample last
        self.phases = np.stack([h[p :: self.up][::-1] for p in range(self.up)]).astype(np.float32)

    def size(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size(len(x)), dtype=np.float32)
        padded = np.concatenate([np.zeros(self.taps - 1, np.float32), x, np.zeros(self.taps, np.float32)])
        view = np.lib.stride_tricks.sliding_window_view(padded, self.taps)
        for k in range(self.up):
            n = np.arange(k, len(out), self.up)
            if len(n):
                first = (k * self.down) // self.up
                phase = (k * self.down) % self.up
                rows = view[first :: self.down][: len(n)]
                for lo in range(0, len(n), 1 << 16):
                    out[k + lo * self.up : k + (lo + (1 << 16)) * self.up : self.up] = np.ascontiguousarray(rows[lo : lo + (1 << 16)]) @ self.phases[phase]
        return out


def mel_bank(rate: int = FEATURE_RATE, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular filters [bin, band], evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_RESAMPLE, _MEL = Resampler(STORED_RATE, FEATURE_RATE), mel_bank()
_SHAPE = np.hanning(FRAME).astype(np.float32)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """[frames, BANDS] of samples at FEATURE_RATE; the last frame is padded with zeros."""
    frames = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    need = (frames - 1) * HOP + FRAME
    x = np.concatenate([samples, np.zeros(need - len(samples), np.float32)]) if need > len(samples) else samples
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    out = np.empty((frames, BANDS), dtype=np.float32)
    for lo in range(0, frames, BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(view[lo : lo + BLOCK_FRAMES] * _SHAPE, axis=1)) ** 2
        out[lo : lo + BLOCK_FRAMES] = np.log10(power.astype(np.float32) @ _MEL + np.float32(1e-6))
    return out


def segments(energy: np.ndarray, rise: float = 0.5, fall: float = -0.25) -> list[tuple[int, int]]:
    """Frame ranges that begin above mean + rise * std and end below mean + fall * std."""
    mean, std = float(energy.mean()), float(energy.std())
    if std < 1e-6:
        return []
    mark = np.where(energy > mean + rise * std, 1, np.where(energy < mean + fall * std, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def time_of(frame: int) -> float:
    return frame * HOP / FEATURE_RATE


def clip_tensors(bands: np.ndarray) -> bytes:
    """Arrow IPC stream: start_s, end_s and a fixed-shape tensor [CLIP, BANDS] of each clip."""
    count = -(-len(bands) // CLIP)
    full = np.zeros((count, CLIP, BANDS), dtype=np.float32)
    full.reshape(-1, BANDS)[: len(bands)] = bands
    table = pa.table({
        "start_s": pa.array([time_of(i * CLIP) for i in range(count)]),
        "end_s": pa.array([time_of(min((i + 1) * CLIP, len(bands))) for i in range(count)]),
        "logmel": pa.FixedShapeTensorArray.from_numpy_ndarray(full),
    })
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time spans [n, 2], tensors [n, CLIP, BANDS]) of a clip_tensors stream."""
    table = pa.ipc.open_stream(stored).read_all()
    spans = np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], axis=1)
    return spans, table.column("logmel").combine_chunks().to_numpy_ndarray()


FIELDS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
    "media_sha256": "string", "feature": "string", "media": "binary", "segments": "array<struct<start_s:double,end_s:double>>", "clips": "binary",
}
DIGEST = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def describe(raw: bytes, wanted: tuple[str, ...]) -> dict[str, object]:
    """The wanted fields of one text's bytes.

    What is told of the payload comes from the stored media, what is told of
    the bands from the stored tensors: both are read back.
    """
    payload = raw + b"\0" * (-len(raw) % ALIGN or (0 if raw else ALIGN))
    media = to_wav(payload)
    rate, stored = from_wav(media)
    if rate != STORED_RATE:
        raise ValueError("unexpected rate")
    samples = (np.frombuffer(stored, dtype=np.uint8).astype(np.float32) - 128) / 128
    clips = clip_tensors(log_mel(_RESAMPLE(samples)))
    spans, tensors = read_tensors(clips)
    frames = round(spans[-1, 1] * FEATURE_RATE / HOP)
    bands = tensors.reshape(-1, BANDS)[:frames]
    found = segments(bands.mean(axis=1, dtype=np.float64))
    active = sum(b - a for a, b in found)
    mean = bands.mean(axis=0, dtype=np.float64)
    out: dict[str, object] = {
        "n_bytes": len(raw), "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(),
        "tail_crc32": zlib.crc32(stored[-ALIGN:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={len(bands)};segments={len(found)};active={active};mel=" + ",".join(f"{v:.2f}" for v in mean),
        "media": media, "clips": clips, "segments": [{"start_s": time_of(a), "end_s": time_of(b)} for a, b in found],
    }
    return {k: out[k] for k in wanted}


def _describe(wanted: tuple[str, ...]):
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_view(batch.column(1))
            lo = 0
            while lo < len(offsets) - 1:  # results of a few MB of text at a time
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (4 << 20), side="right")) - 1)
                rows = [describe(buf[a:b].tobytes(), wanted) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist())]
                columns = [pa.array([r[c] for r in rows], kinds.get(FIELDS[c], span)) for c in wanted]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", *wanted])
                lo = hi

    return run


def media_columns(docs: DataFrame, wanted: tuple[str, ...] = tuple(FIELDS), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the wanted fields of every row.

    A null or empty text is a payload of ALIGN zero bytes.  Repeated rows stay,
    other columns are ignored, an empty table gives an empty table.  `media` is
    the stored file, `clips` an Arrow stream for read_tensors.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {FIELDS[c]}" for c in wanted)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(map_batches, _describe(tuple(wanted)), schema)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """The digests of the stored media, and those of the tensors and time spans beside them."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.sha2("clips", 256).alias("clips_sha256"), F.size("segments").cast("long").alias("n_segments"),
        F.coalesce(F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"]), F.lit(0.0)).alias("active_s"),
    )
