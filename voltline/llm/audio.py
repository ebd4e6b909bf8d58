"""Audio columns: lossless 8-bit WAV media, and features read back from the stored bytes.

Features: polyphase resampling to five eighths of the rate, log-mel energies of overlapping frames as fixed-shape
Arrow tensors with time spans, and segments of sound by energy with hysteresis.
"""

from __future__ import annotations

import io
import wave
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 16_000
UP, DOWN = 5, 8
TAPS = 24
AT_ONCE = 1 << 16
FRAME, HOP, FFT = 320, 160, 512
MELS, BLOCK = 32, 32
HIGH_DB, LOW_DB = -6.0, -12.0
PAD = 64


def _little(x: F.Column, n_bytes: int) -> F.Column:
    digits = F.lpad(F.hex(x), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n_bytes))]))


def encode_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """(id, n_bytes, media) per row: the text's UTF-8, filled with bytes 0 to a positive multiple of 64, as
    unsigned 8-bit mono samples in a WAV file. Null counts as empty; repeated rows and null ids give a row
    each; empty tables give empty tables; further columns are ignored."""
    body = common.text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    fill = F.when(F.col("n_bytes") == 0, PAD).otherwise(F.pmod(-F.col("n_bytes"), F.lit(PAD)))
    payload = F.concat("body", F.unhex(F.expr("repeat('00', cast(fill as int))")))
    rows = rows.withColumn("fill", fill).select("id", "n_bytes", payload.alias("payload"), (F.col("n_bytes") + F.col("fill")).alias("size"))
    text = lambda s: F.lit(s).cast("binary")
    number = lambda x, n: _little(F.lit(x).cast("bigint"), n)
    header = [text("RIFF"), _little(F.col("size") + 36, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(rate, 4), number(1, 2), number(8, 2), text("data"), _little(F.col("size"), 4)]
    return rows.select("id", "n_bytes", F.concat(*header, F.col("payload")).alias("media"))


def read_wav(media: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(media)) as f:
        return f.getframerate(), f.readframes(f.getnframes())


@cache
def lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed sinc at the lower of the two Nyquist rates; ``taps`` per phase."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    return (np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1] * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: each of the ``up`` output phases has a branch of the filter, applied at output places only, AT_ONCE of them at a time."""
    n = -(-len(x) * up // down)
    out, h = np.zeros(n, np.float32), lowpass(up, down, taps)
    padded = np.concatenate((np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)))
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    delay = (taps * up) // 2
    for k in range(min(up, n)):
        at = k * down + delay
        branch, phase = h[at % up :: up][::-1], out[k::up]
        for first in range(0, len(phase), AT_ONCE):
            places = at // up + down * np.arange(first, min(first + AT_ONCE, len(phase)))
            phase[first : first + AT_ONCE] = np.ascontiguousarray(views[np.minimum(places, len(views) - 1)]) @ branch
    return out


@cache
def mel_filters(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles with equal spacing on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS in dB, to a 16th; each frame's energy in dB)."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate((x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n)
    for at in range(0, n, 4096):
        part = frames[at : at + 4096]
        energy[at : at + 4096] = (part.astype(np.float64) ** 2).mean(axis=1)
        power = np.abs(np.fft.rfft(part * np.hanning(FRAME).astype(np.float32), FFT)) ** 2
        mels[at : at + 4096] = 10 * np.log10(power.astype(np.float32) @ mel_filters(rate) + 1e-10)
    return np.round(mels * 16) / 16, np.round(10 * np.log10(energy + 1e-10), 3)


def sound_segments(energy_db: np.ndarray, rate: int) -> list[tuple[float, float]]:
    """Time spans of sound: it begins above the peak + HIGH_DB and lasts until below the peak + LOW_DB."""
    peak = energy_db.max()
    marks = np.where(energy_db >= peak + HIGH_DB, 1, np.where(energy_db < peak + LOW_DB, -1, 0))
    last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
    sound = np.concatenate(([0], np.where(last >= 0, marks[last] == 1, False).astype(int), [0]))
    edges = np.diff(sound)
    return [(round(a * HOP / rate, 4), round(((b - 1) * HOP + FRAME) / rate, 4)) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def tensors(mels: np.ndarray, rate: int) -> bytes:
    """Arrow IPC stream: a fixed-shape tensor column of BLOCK x MELS float32 and the time span of each block; the last is filled with its least value."""
    n = -(-len(mels) // BLOCK)
    full = np.concatenate((mels, np.full((n * BLOCK - len(mels), MELS), mels.min(), np.float32))).reshape(n, BLOCK, MELS)
    starts = np.arange(n) * BLOCK * HOP / rate
    ends = (np.minimum((np.arange(n) + 1) * BLOCK, len(mels)) - 1) * HOP / rate + FRAME / rate
    batch = pa.RecordBatch.from_arrays([pa.array(starts), pa.array(ends), pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(full, np.float32))], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def audio_features(clips: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """``clips`` with rate, n_samples, payload (the samples read back), tensors (Arrow IPC) and segments.

    Null media gives nulls. Clips without samples count as one silent frame. Repeated rows give a row each;
    empty tables give empty tables; columns of these five names are replaced.
    """
    new = ("rate", "n_samples", "payload", "tensors", "segments")
    others = [c for c in clips.columns if c not in new]
    source = clips.select(*[F.col(f"`{c}`") for c in others])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for media in batch.column(media_col).to_pylist():
            if media is None:
                rows.append((None,) * 5)
                continue
            rate, payload = read_wav(media)
            x = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
            mels, energy = log_mel(x, rate * UP // DOWN)
            segments = [{"start_s": a, "end_s": b} for a, b in sound_segments(energy, rate * UP // DOWN)]
            rows.append((rate, len(payload), payload, tensors(mels, rate * UP // DOWN), segments))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), spans)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*others, *new])

    return common.map_arrow(source, run, f"{schema}, rate bigint, n_samples bigint, payload binary, tensors binary, segments array<struct<start_s: double, end_s: double>>")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(encode_wav(common.documents(spark, sf_dir)))
    sound = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x.end_s - x.start_s)
    size = F.octet_length("payload")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        size.cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - PAD + 1, F.lit(PAD))).cast("bigint").alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("segments"), F.format_string("%.3f", sound), F.sha2("tensors", 256)).alias("feature"),
    )
