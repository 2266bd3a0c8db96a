"""WAV files as relations: headers by walking their chunks with expressions, samples as frames that are rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shipping import ship

TARGET_RATE = 16_000
#: Seconds of audio in a row.
SECONDS = 1
#: Bytes that a task gathers before it sends them on, and products of the filter at a time: what a Python worker holds beside its input.
SENT, PRODUCTS = 4 << 20, 1 << 18
# Limits of the warnings, and the frames that silence is judged by.
SHORTEST_S, LONGEST_S, LOWEST_RMS, SILENCE_MS = 0.05, 120.0, 1e-4, 20.0


def _little(content: Column, at: Column, size: int) -> Column:
    """The unsigned little-endian number of ``size`` bytes from place ``at`` (from 1)."""
    digits = F.hex(F.substring(content, at, F.lit(size)))
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("long")


def wav_header(content: Column) -> Column:
    """IO-10: struct rate, channels, width, start (from 1) and size of the samples; null if the bytes are no PCM file.

    Chunks are walked from the first on, whatever their order and number. Samples that the file is too short for are left out.
    """
    size = F.octet_length(content)
    begin = F.struct(F.lit(13).cast("long").alias("at"), F.lit(0).cast("long").alias("fmt"), F.lit(0).cast("long").alias("data"), F.lit(0).cast("long").alias("bytes"))

    def step(s: Column, _: Column) -> Column:
        name, length = F.substring(content, s["at"], F.lit(4)).cast("string"), _little(content, s["at"] + 4, 4)
        data = name == "data"
        new = F.struct(
            (s["at"] + 8 + length + length % 2).alias("at"), F.when(name == "fmt ", s["at"] + 8).otherwise(s["fmt"]).alias("fmt"), F.when(data, s["at"] + 8).otherwise(s["data"]).alias("data"),
            F.when(data, length).otherwise(s["bytes"]).alias("bytes"),
        )
        return F.when((s["data"] > 0) | (s["at"] + 7 > size), s).otherwise(new)

    chunks = F.sequence(F.lit(1), F.greatest(F.lit(1), (size / 8).cast("int")))
    riff = (F.substring(content, F.lit(1), F.lit(4)).cast("string") == "RIFF") & (F.substring(content, F.lit(9), F.lit(4)).cast("string") == "WAVE")

    def fields(f: Column) -> Column:
        return F.struct(
            _little(content, f["fmt"], 2).alias("code"), _little(content, f["fmt"] + 2, 2).alias("channels"), _little(content, f["fmt"] + 4, 4).alias("rate"),
            F.floor((_little(content, f["fmt"] + 14, 2) + 7) / 8).alias("width"), f["data"].alias("start"), F.least(f["bytes"], size - f["data"] + 1).alias("bytes"),
        )

    # lambdas over one element, so that the chunks are walked once and the header is read once
    found = F.filter(F.array(F.aggregate(chunks, begin, step)), lambda f: (f["fmt"] > 0) & (f["data"] > 0))
    usable = F.filter(F.transform(found, fields), lambda h: h["code"].isin(1, 0xFFFE) & (h["channels"] > 0) & (h["rate"] > 0) & h["width"].between(1, 4))
    return F.when((size >= 12) & riff, F.get(usable, F.lit(0)))


def _wav_head(size: Column, rate: Column, channels: Column) -> Column:
    """Hex digits of the 44 bytes before ``size`` bytes of 16-bit samples."""

    def little(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value.cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])

    text = lambda s: F.lit(s.encode().hex())
    return F.concat(
        text("RIFF"), little(36 + size, 4), text("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * channels * 2, 4), little(channels * 2, 2),
        little(F.lit(16), 2), text("data"), little(size, 4),
    )


def pcm16_wav(samples: Column, rate: Column, channels: Column | None = None) -> Column:
    """IO-11: the bytes of a file of 16-bit samples, given as interleaved doubles from -1 to 1; what is beyond is clipped."""
    channels = F.lit(1) if channels is None else channels

    def digits(x: Column) -> Column:
        value = (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int")
        # the low byte goes first (two copies side by side, shifted by a byte); a bit above both keeps the leading zeros
        return F.substring(F.hex(F.shiftright(value.bitwiseAND(0xFFFF).cast("long") * 0x10001, 8).bitwiseAND(0xFFFF).bitwiseOR(0x10000)), 2, 4)

    # a lambda over one element, so that the samples are made once
    return F.unhex(F.get(F.transform(F.array(samples), lambda s: F.concat(_wav_head(2 * F.size(s), rate, channels), F.array_join(F.transform(s, digits), ""))), F.lit(0)))


def _signal(raw: bytes, width: int) -> np.ndarray:
    raw = raw[: len(raw) - len(raw) % width]
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        padded = np.zeros((len(raw) // 3, 4), np.uint8)
        padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return padded.view("<i4")[:, 0] / float(1 << 31)
    return np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))


def audio_rows(files: DataFrame, before: Column | None = None, whole_frames: bool = False, keys: tuple[str, ...] = ("path",), every: bool = False) -> DataFrame:
    """(*keys, h, i, pcm): the samples of each readable file in rows of SECONDS, numbered; ``before`` adds so many samples of a channel on both sides.

    With ``every``, a file without samples has a row without number and samples, an unreadable one also without ``h``.
    """
    h = F.col("h")
    size = h["rate"] * SECONDS * h["width"] * h["channels"]
    frame = h["width"] * h["channels"]
    usable = F.floor(h["bytes"] / frame) * frame if whole_frames else h["bytes"]
    heads = files.select(*keys, "content", wav_header(F.col("content")).alias("h"))
    rows = (heads if every else heads.where("h IS NOT NULL")).withColumns({"_size": size, "_bytes": usable, "_pad": (F.lit(0) if before is None else before) * frame})
    count = F.ceil(F.col("_bytes") / F.col("_size")).cast("int")

    def piece(i: Column) -> Column:
        first = F.greatest(F.lit(0), i * F.col("_size") - F.col("_pad"))
        last = F.least(F.col("_bytes"), (i + 1) * F.col("_size") + F.col("_pad"))
        return F.struct(i.alias("i"), F.substring(F.col("content"), (h["start"] + first).cast("int"), (last - first).cast("int")).alias("pcm"))

    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), piece))
    return rows.select(*keys, "h", (F.inline_outer if every else F.inline)(pieces))


def _levels(rows: DataFrame) -> DataFrame:
    """(path, squares, n) of each row of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals = [_signal(raw.as_py(), width) for raw, width in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x @ x) for x in signals]), pa.array([len(x) for x in signals], pa.int64())], ["path", "squares", "n"])

    return rows.select("path", "pcm", "h.width").mapInArrow(run, "path string, squares double, n long")


def inspect_audio(files: DataFrame, target_rate: int = TARGET_RATE) -> DataFrame:
    """FN-28: a report of each row of path and content: duration, rate, channels, width, RMS and warnings.

    A null content is a file that was not found. The duration counts the samples of all channels, as the surveyed report does. Levels are summed over rows of a second, so a long file is many rows; paths are distinct.
    """
    ship(files.sparkSession)
    heads = files.select("path", F.col("content").isNotNull().alias("exists"), wav_header(F.col("content")).alias("h"))
    levels = _levels(audio_rows(files)).groupBy("path").agg(F.sum("squares").alias("_s"), F.sum("n").alias("_n"))
    rows = heads.join(levels, "path", "left")
    n, readable = F.coalesce("_n", F.lit(0)), F.col("h").isNotNull()
    seconds, rms = n / F.col("h.rate"), F.when(n > 0, F.sqrt(F.col("_s") / n)).otherwise(0.0)
    found = {
        "audio_not_mono": F.col("h.channels") != 1, "audio_sample_rate_not_16k": F.col("h.rate") != target_rate, "audio_not_16bit_pcm": F.col("h.width") != 2,
        "audio_duration_too_short": seconds <= SHORTEST_S, "audio_duration_too_long": seconds > LONGEST_S, "audio_rms_very_low": rms < LOWEST_RMS,
    }
    listed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))
    warnings = F.when(~F.col("exists"), F.array(F.lit("audio_file_not_found"))).when(~readable, F.array(F.lit("audio_not_readable"))).otherwise(listed)
    value = lambda c: F.when(readable, c)
    return rows.select(
        "path", "exists", readable.alias("readable"), value(F.round(seconds, 6)).alias("duration_sec"), F.col("h.rate").cast("int").alias("sample_rate"), F.col("h.channels").cast("int").alias("channels"),
        F.col("h.width").cast("int").alias("sample_width_bytes"), value(F.round(rms, 8)).alias("rms"), (F.size(warnings) > 0).alias("needs_preprocess"), warnings.alias("warnings"),
    )


@lru_cache(maxsize=8)
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc (Kaiser, 5.0) of ten periods a side at the lower of both rates, of unit gain times ``up``."""
    half, rate = 10 * max(up, down), max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / rate) * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def reach(up: int, down: int) -> int:
    """Samples of the input that an output sample sees on each side."""
    return 10 * max(up, down) // up + 2


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """The filter's weights of the samples around an output sample, a row for each of its ``up`` phases."""
    h, half, span = low_pass(up, down), 10 * max(up, down), reach(up, down)
    tap = np.arange(up)[:, None] - np.arange(-span, span + 1)[None, :] * up + half
    return np.where((tap >= 0) & (tap <= 2 * half), h[np.clip(tap, 0, 2 * half)], 0.0)


def resampled(x: np.ndarray, up: int, down: int, first: int, outputs: range) -> np.ndarray:
    """Samples ``outputs`` of the signal at up / down of its rate; ``x`` holds its samples from ``first`` on, what is missing is silence."""
    out = np.zeros(len(outputs))
    if not len(x) or not len(out):
        return out
    weights, span = _phases(up, down), reach(up, down)
    low = outputs.start * down // up - span
    seen = np.zeros((outputs.stop - 1) * down // up + span + 1 - low)
    begin, end = max(first, low), min(first + len(x), low + len(seen))
    if begin < end:
        seen[begin - low : end - low] = x[begin - first : end - first]
    around = np.lib.stride_tricks.sliding_window_view(seen, 2 * span + 1)
    step = max(1, PRODUCTS // (2 * span + 1))
    for at in range(0, len(out), step):
        place = np.arange(outputs.start + at, min(outputs.stop, outputs.start + at + step)) * down
        products = weights[place % up]
        products *= around[place // up - span - low]
        out[at : at + step] = products.sum(axis=1)
    return out


def _sent(rows: Iterable[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches that are sent on as soon as their column ``at`` has SENT bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"") + 64
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, pcm) of (path, file, pcm): rows of a file follow one another and become one; a file whose rows are all null stays null."""

    def rows() -> Iterator[tuple[str | None, int, bytes | None]]:
        for batch in batches:
            for path, file, pcm in zip(batch.column(0), batch.column(1), batch.column(2)):
                yield path.as_py(), file.as_py(), pcm.as_py()

    def files() -> Iterator[tuple[str | None, bytes | None]]:
        for (path, _), parts in groupby(rows(), key=lambda r: r[:2]):
            found = [pcm for _, _, pcm in parts if pcm is not None]
            yield path, b"".join(found) if found else None

    yield from _sent(files(), pa.schema({"path": pa.string(), "pcm": pa.binary()}), 1)


def preprocess_audio(files: DataFrame, trim: bool = False, level: float = 0.01, pad_ms: float = 100.0, target_rate: int = TARGET_RATE) -> DataFrame:
    """SQ-27, SQ-28: (path, content) of each file as a mono 16-bit file of the target rate, without the silence at its edges if ``trim``.

    Rows of a second are mixed to one channel and resampled with the samples on both sides that the filter sees; the edges are the first and last frame of
    SILENCE_MS whose RMS reaches ``level``, by a window over the rows of a file, widened by ``pad_ms``; a file without such a frame stays whole. Files that
    can't be read have a null content. Only the parts of one file come together, to be joined; tasks hold a few seconds of audio, or one file there.
    """
    ship(files.sparkSession)
    rate = F.col("h.rate")
    # a second has as many samples as the rate, so rows begin at whole multiples of ``down``
    before = F.when(rate == target_rate, 0).otherwise(F.ceil(10 * F.greatest(F.lit(1.0), rate / target_rate)) + 2)
    # a number for each file, as paths may repeat or be null
    rows = audio_rows(files.select("path", "content", F.monotonically_increasing_id().alias("file")), before, whole_frames=True, keys=("path", "file"), every=True)
    frame, pad = max(1, int(target_rate * SILENCE_MS / 1000)), int(target_rate * pad_ms / 1000)

    def part(raw: bytes, i: int, r: int, channels: int, width: int, size: int) -> tuple[bytes, int, int | None, int | None]:
        x = _signal(raw, width).reshape(-1, channels).mean(axis=1)
        if r != target_rate:
            g = gcd(r, target_rate)
            up, down = target_rate // g, r // g
            n = size // (width * channels)
            total = -(-n * up // down)
            span = int(np.ceil(10 * max(1.0, r / target_rate))) + 2
            last = min(total, -(-(i + 1) * r * SECONDS * up // down)) if (i + 1) * r * SECONDS < n else total
            x = resampled(x, up, down, max(0, i * r * SECONDS - span), range(i * r * SECONDS * up // down, last))
        loud = np.array([np.sqrt(np.mean(x[a : a + frame] ** 2)) >= level for a in range(0, len(x), frame)], bool)
        at = np.flatnonzero(loud)
        pcm = (np.clip(x.astype(np.float32).astype(np.float64), -1.0, 1.0) * 32767).astype("<i2").tobytes()
        return pcm, len(x), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for raw, path, file, i, r, *form in zip(batch.column(0), *(batch.column(k).to_pylist() for k in range(1, 8))):
                    if i is None:
                        yield path, file, 0, None if r is None else b"", 0, None, None
                    else:
                        yield path, file, i, *part(raw.as_py(), i, r, *form)

        long = pa.int64()
        yield from _sent(parts(), pa.schema({"path": pa.string(), "file": long, "i": long, "pcm": pa.binary(), "n": long, "first": long, "last": long}), 3)

    seconds = rows.select("pcm", "path", "file", F.col("i").cast("long").alias("i"), "h.rate", "h.channels", "h.width", F.col("h.bytes").alias("size"))
    parts = seconds.mapInArrow(run, "path string, file long, i long, pcm binary, n long, first long, last long").repartition("path")
    offset = F.col("i") * target_rate * SECONDS
    whole = Window.partitionBy("path", "file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = parts.withColumns({
        "_n": F.sum("n").over(whole), "_from": F.min(offset + F.col("first") * frame).over(whole), "_to": F.max(offset + (F.col("last") + 1) * frame).over(whole),
    })
    low = F.when(F.col("_from").isNull() | F.lit(not trim), 0).otherwise(F.greatest(F.lit(0), F.col("_from") - pad))
    high = F.when(F.col("_to").isNull() | F.lit(not trim), F.col("_n")).otherwise(F.least(F.col("_n"), F.col("_to") + pad))
    begin, end = F.greatest(low - offset, F.lit(0)), F.least(high - offset, F.col("n"))
    kept = edges.select("path", "file", "i", F.substring("pcm", (2 * begin + 1).cast("int"), F.greatest(2 * (end - begin), F.lit(0)).cast("int")).alias("pcm"))
    joined = kept.sortWithinPartitions("path", "file", "i").select("path", "file", "pcm").mapInArrow(_joined, "path string, pcm binary")
    return joined.select("path", F.concat(F.unhex(_wav_head(F.octet_length("pcm"), F.lit(target_rate), F.lit(1))), "pcm").alias("content"))
