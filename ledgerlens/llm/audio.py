"""Media columns: texts' bytes stored as 8-bit audio, read back, and described by fixed-shape log-mel tensors.

store() writes a payload as the samples of a one-channel 8-bit WAV file (RIFF), one file a row, without loss. describe()
reads such files: polyphase resampling, overlapped windows, log-mel filterbanks, and segments where the energy rises
above one threshold until it falls below a lower one. The features of a file are an Arrow stream of rows (start, end,
log_mel): clips of a fixed number of frames as a fixed-shape tensor column, each with its time span in seconds; the last
clip is filled up with silence. Energies are stored in half precision: between log(FLOOR) = -18.4 and their largest, below
12, the rounding is at most 0.008, a thirtieth of a decibel, and a file's tensors take half the disk.

A file is handled by itself, in one task, so that equal files have equal features; a task holds one batch and one file's
frames. Nulls and empty payloads become one unit of filling. Files that are no such WAV files fail with their reason.
Documents that repeat are described one by one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

UNIT, FILL = 576, b"\xff"
RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, FFT, MELS, CLIP = 200, 80, 256, 24, 64
#: Decibels below a file's loudest frame where a segment begins and ends.
BEGIN, FINISH = 3.0, 6.0
FLOOR = 1e-8
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples; chunks are filled up to even length."""
    body = samples + b"\0" * (len(samples) % 2)
    return HEADER.pack(b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + body


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a RIFF file of one channel of 8 bits, whatever further chunks it has."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError(f"format {kind}, {channels} channels of {bits} bits")
        if name == b"data":
            if not rate or at + 8 + size > len(media):
                raise ValueError("no format, or the data end early")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data")


@lru_cache
def low_pass(up: int, down: int, half: int = 12) -> np.ndarray:
    """Windowed-sinc taps for a change of rate by up/down, of gain `up`."""
    cut, n = 1 / max(up, down), half * max(up, down)
    t = np.arange(-n, n + 1)
    taps = cut * np.sinc(cut * t) * np.hanning(2 * n + 3)[1:-1]
    return taps * up / taps.sum()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down times its rate: each output takes the taps of its phase only (no zeros are multiplied)."""
    taps = low_pass(up, down)
    centre, count = len(taps) // 2, -(-len(x) * up // down)
    out = np.empty(count)
    for first in range(up):
        if first >= count:
            break
        # Output i = first + up*j lies at i*down of the stuffed signal; x[k] weighs taps[i*down - k*up + centre].
        at = first * down + centre
        phase, k0 = at % up, at // up
        own = taps[phase::up]
        padded = np.concatenate([np.zeros(len(own)), x, np.zeros(len(own) + k0 + down)])
        rows = len(range(first, count, up))
        view = np.lib.stride_tricks.sliding_window_view(padded, len(own))[k0 + 1 :: down][:rows]
        out[first::up] = view @ own[::-1]
    return out


@lru_cache
def mel_bank(rate: int) -> np.ndarray:
    """(bins, MELS) triangles equally spaced on the mel scale up to half the rate."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down))


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """Frames [from, to) that are on: from a level above BEGIN's threshold until one below FINISH's."""
    top = level.max()
    mark = np.where(level >= top - BEGIN, 1, np.where(level < top - FINISH, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]], float]:
    """(frames, MELS) log-mel energies, the spans of the segments in seconds, and seconds for each frame."""
    x = resample((np.frombuffer(samples, np.uint8) - 128.0) / 128)
    own = rate * UP / DOWN
    x = np.concatenate([x, np.zeros(max(0, WINDOW - len(x)))])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    frames = frames - frames.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * np.hanning(WINDOW), FFT)) ** 2
    mel = np.log(power @ mel_bank(int(own)) + FLOOR).astype(np.float32)
    level = 10 * np.log10((frames**2).mean(axis=1) + FLOOR)
    step = HOP / own
    return mel, [(round(a * step, 4), round(((b - 1) * HOP + WINDOW) / own, 4)) for a, b in segments(level)], step


def tensors(mel: np.ndarray, step: float) -> bytes:
    """An Arrow stream of rows (start, end, log_mel); log_mel is a fixed-shape tensor of CLIP frames by MELS."""
    count = -(-len(mel) // CLIP)
    filled = np.full((count * CLIP, MELS), np.log(FLOOR), np.float16)
    filled[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), [CLIP, MELS])
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(filled.reshape(-1)), CLIP * MELS))
    starts = np.arange(count) * CLIP * step
    batch = pa.record_batch([pa.array(starts), pa.array(np.minimum(starts + CLIP * step, len(mel) * step)), column], names=["start", "end", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def clips_of(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tensors() stored: the clips' starts and ends in seconds, and an array (clips, CLIP, MELS)."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    clips = table["log_mel"].chunk(0).to_numpy_ndarray()
    return table["start"].to_numpy(), table["end"].to_numpy(), clips


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes, filled up to a positive multiple of UNIT, as a WAV file. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                media = [wav(t + FILL * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t))) for t in texts]
                yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return written(source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary"), "media", compression="zstd")


DESCRIBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames int, segments array<struct<start: double, end: double>>, mean_log_mel array<float>"


def describe(media: DataFrame, passed: list[str], media_col: str = "media", keep_tensors: bool = False) -> DataFrame:
    """The passed columns of media, digests of the payload read back and of the file, and its features."""
    names = [*passed, *[x.split()[0] for x in DESCRIBED.replace("struct<start: double, end: double>", "s").split(", ")], *["tensors"] * keep_tensors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), span, pa.list_(pa.float32()), *[pa.binary()] * keep_tensors]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for m in batch.column(len(passed)):
                    m = m.as_py()
                    samples, rate = samples_of(m)
                    mel, on, step = features(samples, rate)
                    spans = [{"start": a, "end": b} for a, b in on]
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), len(mel), spans, mel.mean(axis=0), *[tensors(mel, step)] * keep_tensors))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([*batch.columns[: len(passed)], *cols], names=names)

    source = media.select(*passed, media_col)
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in passed)
    return source.mapInArrow(run, f"{kinds}, {DESCRIBED}" + ", tensors binary" * keep_tensors)


RECALLED = "clips int, clip_seconds double, stored_log_mel array<float>, tensors_sha256 string"


def recalled(described: DataFrame, passed: list[str]) -> DataFrame:
    """The passed columns and what the stored tensors say: clips, their seconds, the mean over their frames (without the filling), and a digest of spans and clips in order."""
    names = [*passed, *[x.split()[0] for x in RECALLED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for frames, t in zip(batch.column(len(passed)).to_pylist(), batch.column(len(passed) + 1), strict=True):
                    start, end, mel = clips_of(t.as_py())
                    digest = hashlib.sha256(start.tobytes() + end.tobytes() + mel.tobytes()).hexdigest()
                    rows.append((len(start), float((end - start).sum()), mel.reshape(-1, MELS)[:frames].mean(axis=0, dtype=np.float32), digest))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([*batch.columns[: len(passed)], *cols], names=names)

    source = described.select(*passed, "frames", "tensors")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    return source.mapInArrow(run, f"{kinds}, {RECALLED}")


def op7_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    passed = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    described = written(describe(store(docs), passed[:2], keep_tensors=True).drop("mean_log_mel"), "tensors", compression="zstd")
    out = recalled(described, [*passed, "frames", "segments"])
    heard = F.expr("aggregate(segments, 0D, (s, x) -> s + x.end - x.start)")
    mel = F.array_join(F.transform("stored_log_mel", lambda x: F.format_number(x.cast("double"), 2)), "|")
    clips = F.concat_ws(":", F.col("clips").cast("string"), F.format_number("clip_seconds", 3), "tensors_sha256")
    feature = F.concat_ws(";", F.col("frames").cast("string"), F.size("segments").cast("string"), F.format_number(heard, 3), mel, clips)
    return out.select(*passed, feature.alias("feature"))
