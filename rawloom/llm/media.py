"""Audio features: payloads stored as 8-bit PCM, polyphase resampling, log-mel filterbanks, energy segments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, raw
from rawloom.session import ship

#: A payload is a positive multiple of this many bytes, filled up with PAD.
UNIT, PAD = 576, b"\xff"
#: Samples are stored at RATE and analysed at RATE * UP / DOWN.
RATE, UP, DOWN = 12_000, 2, 3
#: Taps of each phase of the low-pass filter.
PHASE_TAPS = 24
FRAME, HOP, MELS = 256, 128, 40
#: Frames of one tensor; the last one of a payload is filled up with FLOOR.
CLIP = 64
#: Log energies are kept as hundredths in 16 bits.
SCALE, FLOOR = 100, -1000
#: A segment starts at a frame energy of mean + ON deviations and goes on while it is mean + OFF or more.
ON, OFF = 0.5, -0.25


def payload_of(text: bytes) -> bytes:
    """The bytes of a text, filled up with bytes 255 to a positive multiple of UNIT."""
    return text + PAD * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _kernel() -> np.ndarray:
    """One column for each of the two outputs that three samples make: the phases of a windowed sinc."""
    taps = PHASE_TAPS * UP
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(taps)
    h *= UP / h.sum()
    out = np.zeros((PHASE_TAPS + 1, 2), np.float32)
    out[:PHASE_TAPS, 0] = h[0::2][::-1]
    out[1:, 1] = h[1::2][::-1]
    return out


def _mel() -> np.ndarray:
    """Triangular filters on the mel scale, from 0 to half of the analysis rate."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_KERNEL, _MEL, _HANN = _kernel(), _mel(), np.hanning(FRAME + 1)[:-1].astype(np.float32)
#: Outputs and frames that are made at once; fixed, so that equal payloads get equal values.
_STEP = 1 << 15


def resample(samples: np.ndarray) -> np.ndarray:
    """RATE to RATE * UP / DOWN by polyphase filtering; the number of samples is a multiple of DOWN."""
    padded = np.concatenate((np.zeros(PHASE_TAPS // 2, np.float32), samples, np.zeros(PHASE_TAPS // 2 + 1, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, PHASE_TAPS + 1)[: len(samples) : DOWN]
    return np.concatenate([(windows[i : i + _STEP] @ _KERNEL).ravel() for i in range(0, len(windows), _STEP)])


def analyse(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS, 16-bit) and segments (n x 2, in frames) of the samples of a payload."""
    wave = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP]
    logs, energy = [], []
    for i in range(0, len(frames), _STEP // 8):
        part = frames[i : i + _STEP // 8]
        spectrum = np.fft.rfft(part * _HANN)
        power = spectrum.real**2 + spectrum.imag**2
        logs.append(np.rint(SCALE * np.log10(np.maximum(power @ _MEL, 1e-10))))
        energy.append(np.rint(SCALE * np.log10(np.maximum(np.einsum("ij,ij->i", part, part), 1e-10))))
    return np.concatenate(logs).astype(np.int16), segments(np.concatenate(energy).astype(np.float64))


def segments(energy: np.ndarray) -> np.ndarray:
    """Runs of frames that start at the upper threshold and last until the energy falls below the lower one."""
    high, low = energy.mean() + ON * energy.std(), energy.mean() + OFF * energy.std()
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.where(known >= 0, mark[known], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], active, [0]))))
    return edges.reshape(-1, 2)


def tensors(logs: np.ndarray) -> pa.RecordBatch:
    """Clips of CLIP frames as a fixed-shape tensor column with their spans in seconds."""
    n = -(-len(logs) // CLIP)
    filled = np.full((n * CLIP, MELS), FLOOR, np.int16)
    filled[: len(logs)] = logs
    seconds = HOP / (RATE * UP / DOWN)
    starts = np.arange(n) * CLIP
    spans = [starts * seconds, (np.minimum(starts + CLIP, len(logs)) - 1) * seconds + FRAME / HOP * seconds]
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, CLIP, MELS))
    return pa.record_batch([column, *map(pa.array, spans)], names=["log_mel", "start_s", "end_s"])


def pack(batch: pa.RecordBatch) -> bytes:
    """A record batch as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(stored: bytes) -> pa.RecordBatch:
    """The record batch of an Arrow stream, tensors included."""
    return pa.ipc.open_stream(stored).read_all().combine_chunks().to_batches()[0]


SCHEMA = "n_bytes long, media binary, payload binary, clips binary, n_frames long, segments array<struct<start_s:double,end_s:double>>"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored media and audio features of every whole text.

    media: a WAV file whose 8-bit samples are the padded UTF-8 bytes.  payload: the samples read back from it.
    clips: an Arrow stream of fixed-shape tensors [64, 40] of log-mel energies (hundredths of log10, int16) with
    their time spans.  segments: spans of hysteresis energy segmentation.  Everything is a function of the text
    alone; equal texts have equal rows.  A null text counts as empty (one unit of padding); a very long text is analysed
    whole, in bounded steps; frames at equal energies are silence; null ids and repeated rows are kept; further columns,
    whatever their names, are ignored; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    seconds = HOP / (RATE * UP / DOWN)
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col, 1 << 20):
            rows = []
            for text in raw(part, text_col):
                media = to_wav(payload_of(text))
                payload = from_wav(media)
                logs, found = analyse(payload)
                rows.append((len(text), media, payload, pack(tensors(logs)), len(logs), [{"start_s": a * seconds, "end_s": b * seconds} for a, b in found.tolist()]))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), span)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([part.column(0), *columns], names=["id", "n_bytes", "media", "payload", "clips", "n_frames", "segments"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, {SCHEMA}")


def digests(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and digests of what audio_features() returns."""
    feature = F.concat_ws(";", F.col("n_frames").cast("string"), F.size("segments").cast("string"), F.round(F.aggregate("segments", F.lit(0.0), lambda a, x: a + x.end_s - x.start_s), 3).cast("string"), F.sha2("clips", 256))
    return features.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
