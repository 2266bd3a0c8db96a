"""WAV headers, inspection and preparation against the wave module and plain versions."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import audio


def wav(signal, rate=16_000, channels=1, width=2, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        full = np.clip(signal, -1, 1) * ((1 << (8 * width - 1)) - 1)
        if width == 1:
            raw = (full + 128).astype(np.uint8).tobytes()
        elif width == 3:
            raw = full.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            raw = full.astype(f"<i{width}").tobytes()
        w.writeframes(raw)
    data = out.getvalue()
    return data[:12] + extra + data[12:]


def read(content):
    with wave.open(io.BytesIO(content)) as w:
        return w.getframerate(), w.getnchannels(), w.getsampwidth(), np.frombuffer(w.readframes(w.getnframes()), "<i2")


def table(spark, **files):
    return spark.createDataFrame([(name, None if content is None else bytearray(content)) for name, content in files.items()], "path string, content binary")


TONE = 0.5 * np.sin(2 * np.pi * 440 * np.arange(40_000) / 16_000)


def test_inspection(spark):
    odd = b"LIST" + struct.pack("<I", 5) + b"abcde\0" + b"junk" + struct.pack("<I", 0)
    files = {
        "good": wav(TONE), "chunks": wav(TONE, extra=odd), "stereo": wav(TONE, 44_100, 2), "wide": wav(TONE, 8_000, 1, 3), "bytes": wav(TONE, 16_000, 1, 1), "long4": wav(TONE, width=4),
        "short": wav(TONE[:800]), "empty": wav(TONE[:0]), "silent": wav(np.zeros(3_000)), "cut": wav(TONE)[:1_001], "text": b"no audio at all", "none": b"", "missing": None, "long": wav(np.full(121 * 8_000, 0.1), 8_000),
    }
    got = {r.path: r for r in audio.inspect_audio(table(spark, **files)).collect()}
    assert len(got) == len(files)
    for name, rate, channels, width in (("good", 16_000, 1, 2), ("chunks", 16_000, 1, 2), ("stereo", 44_100, 2, 2), ("wide", 8_000, 1, 3), ("bytes", 16_000, 1, 1), ("long4", 16_000, 1, 4)):
        row = got[name]
        assert (row.sample_rate, row.channels, row.sample_width_bytes) == (rate, channels, width)
        assert row.duration_sec == round(40_000 / rate, 6)
        assert row.rms == pytest.approx(np.sqrt(np.mean(TONE**2)), abs=1e-2 if width == 1 else 1e-4)
    assert got["good"].warnings == [] and not got["good"].needs_preprocess
    assert got["stereo"].warnings == ["audio_not_mono", "audio_sample_rate_not_16k"]
    assert got["wide"].warnings == ["audio_sample_rate_not_16k", "audio_not_16bit_pcm"]
    assert got["short"].warnings == ["audio_duration_too_short"]
    assert got["empty"].warnings == ["audio_duration_too_short", "audio_rms_very_low"] and got["empty"].rms == 0
    assert got["silent"].warnings == ["audio_rms_very_low"]
    assert got["long"].warnings == ["audio_sample_rate_not_16k", "audio_duration_too_long"]
    assert got["cut"].duration_sec == round((1_001 - 44) // 2 / 16_000, 6)
    assert got["text"].warnings == got["none"].warnings == ["audio_not_readable"] and got["text"].exists
    assert got["missing"].warnings == ["audio_file_not_found"] and not got["missing"].exists


def test_written_files_are_read_back(spark):
    x = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.0, 1e-5]
    df = spark.createDataFrame([(x,)], "x array<double>").select(audio.pcm16_wav(F.col("x"), F.lit(16_000)).alias("c"), audio.pcm16_wav(F.col("x"), F.lit(8_000), F.lit(2)).alias("d"))
    row = df.first()
    rate, channels, width, samples = read(row.c)
    assert (rate, channels, width) == (16_000, 1, 2)
    assert samples.tolist() == (np.clip(x, -1, 1) * 32767).astype("<i2").tolist()
    assert read(row.d)[:3] == (8_000, 2, 2)


def plain(signal, rate, trim, level=0.01, pad_ms=100.0):
    """The whole signal at once: polyphase filter by its definition, then the edges."""
    if rate != 16_000:
        g = np.gcd(rate, 16_000)
        up, down = 16_000 // g, rate // g
        h, half = audio.low_pass(up, down), 10 * max(up, down)
        spread = np.zeros(len(signal) * up)
        spread[::up] = signal
        signal = np.convolve(spread, h)[half:][: len(signal) * up][::down]
    if trim and len(signal):
        loud = [k for k in range(0, len(signal), 320) if np.sqrt(np.mean(signal[k : k + 320] ** 2)) >= level]
        if loud:
            signal = signal[max(0, loud[0] - int(16 * pad_ms)) : loud[-1] + 320 + int(16 * pad_ms)]
    return signal


@pytest.mark.parametrize("trim", [False, True])
def test_preparation_equals_the_plain_version(spark, trim):
    rng = np.random.default_rng(1)
    parts = [np.zeros(30_000), 0.3 * rng.normal(size=50_000), np.zeros(7), 0.2 * rng.normal(size=9_000), np.zeros(41_000)]
    signal = np.clip(np.concatenate(parts), -1, 1)
    stereo = np.column_stack((signal, -0.5 * signal))
    files = {"same": wav(signal), "down": wav(signal, 44_100), "up": wav(signal, 8_000), "mixed": wav(stereo.ravel(), 48_000, 2), "quiet": wav(np.zeros(5_000), 22_050), "empty": wav(signal[:0]), "bad": b"x", "gone": None}
    got = {r.path: r.content for r in audio.preprocess_audio(table(spark, **files), trim=trim).collect()}
    assert set(got) == set(files) and got["bad"] is None and got["gone"] is None
    pcm = lambda x: (x * 32767).astype("<i2") / 32768
    for name, x, rate in (("same", pcm(signal), 16_000), ("down", pcm(signal), 44_100), ("up", pcm(signal), 8_000), ("mixed", pcm(stereo).mean(axis=1), 48_000), ("quiet", np.zeros(5_000), 22_050)):
        head, samples, want = read(got[name])[:3], read(got[name])[3], plain(x, rate, trim)
        assert head == (16_000, 1, 2)
        assert len(samples) == len(want), name
        assert np.abs(samples / 32767 - np.clip(want, -1, 1)).max() < 2e-4
    assert len(read(got["empty"])[3]) == 0


def test_a_resampled_tone_stays_a_tone():
    t = np.arange(44_100) / 44_100
    x = np.sin(2 * np.pi * 1_000 * t)
    y = audio.resampled(x, 160, 441, 0, range(0, 16_000))
    want = np.sin(2 * np.pi * 1_000 * np.arange(16_000) / 16_000)
    assert np.abs(y - want)[200:-200].max() < 2e-3


def test_tasks_send_few_seconds_at_a_time(spark, monkeypatch):
    """However many seconds come in a batch, a worker hands them on in small ones; before, 1,500 seconds made one batch of 96 MB."""
    send = type(spark.range(0)).mapInArrow

    def watched(self, function, schema, *more):
        def run(batches):
            for batch in function(batches):
                assert batch.nbytes < 16_000_000, batch.nbytes
                yield batch

        return send(self, run, schema, *more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    files = spark.range(0, 1_500, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit(wav(TONE[:8_000], 8_000)).alias("content"))
    got = audio.preprocess_audio(files).groupBy(F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("size")).agg(F.count_distinct("path").alias("n")).collect()
    assert [(r.size, r.n) for r in got] == [(44 + 32_000, 1_500)]


def test_files_of_one_path_or_none_stay_apart(spark):
    files = [("x", wav(TONE[:20_000])), ("x", wav(-TONE[:3_000])), (None, wav(TONE[:17_000])), (None, b"no audio"), (None, wav(TONE[:0]))]
    df = spark.createDataFrame([(path, bytearray(content)) for path, content in files], "path string, content binary")
    got = {(r.path, None if r.content is None else len(read(r.content)[3])) for r in audio.preprocess_audio(df).collect()}
    assert got == {("x", 20_000), ("x", 3_000), (None, 17_000), (None, None), (None, 0)}
