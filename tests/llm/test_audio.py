import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import audio


@pytest.mark.parametrize(("up", "down"), [(1, 1), (1, 2), (2, 1), (3, 2), (2, 3), (160, 441)])
def test_resample_equals_stuffed_convolution(up, down):
    x = np.random.default_rng(1).normal(size=500)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, audio.low_pass(up, down))
    c = len(audio.low_pass(up, down)) // 2
    want = full[c : c + len(stuffed)][::down]
    got = audio.resample(x, up, down)
    assert len(got) == -(-len(x) * up // down)
    np.testing.assert_allclose(got[: len(want)], want[: len(got)], atol=1e-12)


def test_tone_keeps_its_frequency():
    t = np.arange(16_000) / 16_000
    samples = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    mel, on, step = audio.features(samples, 16_000)
    centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), audio.MELS + 2)[1:-1] / 2595) - 1)
    assert abs(centres[mel.mean(axis=0).argmax()] - 1000) < 150 and step == 0.01 and on


def test_hysteresis():
    level = np.array([-20, -20, 0, -4, -5, -7, -4, -1, -20.0])
    assert audio.segments(level) == [(2, 5), (7, 8)]
    assert audio.segments(np.array([-3.0])) == [(0, 1)]


def test_wav_round_trip_and_errors():
    for data in (b"abc" * 192, b"", b"x"):
        assert audio.samples_of(audio.wav(data)) == (data, audio.RATE)
    extra = audio.wav(b"ab")
    extra = extra[:12] + b"LIST\x03\0\0\0abc\0" + extra[12:]
    assert audio.samples_of(extra)[0] == b"ab"
    for bad in (b"", b"RIFF", audio.wav(b"abcd")[:-2]):
        with pytest.raises(ValueError):
            audio.samples_of(bad)


def test_documents(spark):
    rows = [(1, "héllo", "m"), (2, None, "m"), (3, "", "m"), (3, "", "m"), (None, "y" * 576, "m"), (5, "z" * 100_000, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = audio.describe(audio.store(docs), ["doc_id", "n_bytes"], keep_tensors=True).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(audio.wav(payload)), hashlib.sha256(audio.wav(payload)).hexdigest())
        stored = pa.ipc.open_stream(r.tensors).read_all()
        assert stored.schema.field("log_mel").type.shape == [audio.CLIP, audio.MELS]
        assert len(stored) == -(-r.frames // audio.CLIP) and stored["start"][0].as_py() == 0
        mel = np.concatenate([np.asarray(x).reshape(audio.CLIP, audio.MELS) for x in stored["log_mel"].combine_chunks().storage.to_pylist()])[: r.frames]
        np.testing.assert_allclose(mel.mean(axis=0), r.mean_log_mel, rtol=1e-3, atol=1e-3)
    assert audio.describe(audio.store(docs.where("false")), ["doc_id"]).count() == 0


def test_query_feature_is_of_the_stored_clips(spark, tmp_path):
    """Two payloads with the same frames in another order differ in feature; equal ones agree, over one clip and more."""
    quiet, loud = "a" * 160 * 200, "az" * 80 * 200
    texts = {1: quiet + loud, 2: loud + quiet, 3: quiet + loud, 4: "short", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.feature for r in audio.op7_audio(spark, str(tmp_path)).collect()}
    assert got[1] == got[3] != got[2]
    for i, text in texts.items():
        raw = (text or "").encode()
        samples = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        mel, on, step = audio.features(samples, audio.RATE)
        count = -(-len(mel) // audio.CLIP)
        clips = np.full((count * audio.CLIP, audio.MELS), np.log(audio.FLOOR), np.float16)
        clips[: len(mel)] = mel
        start = np.arange(count) * audio.CLIP * step
        end = np.minimum(start + audio.CLIP * step, len(mel) * step)
        frames, number, heard, means, said = got[i].split(";")
        assert float(heard) == pytest.approx(sum(b - a for a, b in on), abs=1e-3)
        np.testing.assert_allclose([float(x) for x in means.split("|")], clips[: len(mel)].astype(np.float64).mean(axis=0), atol=0.006)
        digest = hashlib.sha256(start.tobytes() + end.tobytes() + clips.tobytes()).hexdigest()
        assert (int(frames), int(number), said.split(":")[0], said.split(":")[2]) == (len(mel), len(on), str(count), digest)


def test_log_mel_by_its_definition():
    """Frame by frame and bin by bin: mean taken off, Hann window, discrete Fourier transform, triangles on the mel scale, log."""
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 1500, dtype=np.uint8)
    mel, _, step = audio.features(samples.tobytes(), audio.RATE)
    x, own = audio.resample((samples - 128.0) / 128), audio.RATE // 2
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (to_mel(own / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    assert step == audio.HOP / own and len(mel) == (len(x) - audio.WINDOW) // audio.HOP + 1
    for k in (0, 3, len(mel) - 1):
        frame = x[k * audio.HOP : k * audio.HOP + audio.WINDOW]
        shaped = [(v - frame.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * i / (audio.WINDOW - 1))) for i, v in enumerate(frame)]
        power = [abs(sum(v * np.exp(-2j * np.pi * b * i / audio.FFT) for i, v in enumerate(shaped))) ** 2 for b in range(audio.FFT // 2 + 1)]
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            weight = lambda f: max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))  # noqa: B023, E731
            want = np.log(sum(p * weight(b * own / audio.FFT) for b, p in enumerate(power)) + audio.FLOOR)
            assert mel[k, m] == pytest.approx(want, abs=1e-4)
