"""Audio values: decoding, mixing to mono, resampling. Arrow UDFs, as SQL has no such functions.

Resampling is a windowed-sinc filter of our own: close to, not equal to, any other library's.
"""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Callable, Mapping
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Output samples that are resampled at once.
BLOCK = 8192
#: Zero crossings of the filter on each side, and the most neighbours that a part looks through.
ZEROS = 16
REACH = 64
MONO_RULES = ("smaller", "second", "last", "strict", "first")


def mono(samples: np.ndarray, rule: str = "smaller") -> np.ndarray:
    """One channel by mean. Which dimension holds channels: ``smaller`` (the first if equal),
    ``second``, ``last`` (if it has up to 8, else the first), ``strict`` (the first if it has up
    to 8, else the last if so, else an error), ``first``."""
    if samples.ndim < 2:
        return samples
    a, b = samples.shape
    if rule == "smaller":
        axis = 0 if a <= b else 1
    elif rule == "second":
        axis = 1
    elif rule == "last":
        axis = 1 if b <= 8 else 0
    elif rule == "strict":
        if a > 8 and b > 8:
            raise ValueError("no dimension looks like channels")
        axis = 0 if a <= 8 else 1
    elif rule == "first":
        axis = 0
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return samples.mean(axis=axis)


@lru_cache(maxsize=32)
def filter_bank(rate: int, target: int, zeros: int = ZEROS) -> tuple[int, int, int, np.ndarray]:
    """(L, M, width, taps): the rates in lowest terms, and for each of the L phases the taps of a windowed sinc
    on ``width`` input samples to the left and to the right. Output n stands at n M / L, so phases repeat
    and their taps are worked out once."""
    common = gcd(rate, target)
    up, down = target // common, rate // common
    cut = min(1.0, target / rate)
    width = int(np.ceil(zeros / cut))
    phase = np.arange(up) * down % up / up  # how far output n stands to the right of an input sample
    gap = phase[:, None] - np.arange(-width + 1, width + 1)[None, :]
    return up, down, width, cut * np.sinc(cut * gap) * np.cos(np.pi * np.clip(gap / width, -1, 1) / 2) ** 2


def resampled_span(samples: np.ndarray, start: int, length: int, rate: int, target: int, first: int, last: int) -> np.ndarray:
    """Output samples ``first`` to below ``last`` of a recording of ``length``, from a stretch of it that begins at
    ``start`` and reaches a filter's width beyond them on both sides, or to the recording's ends."""
    up, down, width, taps = filter_bank(rate, target)
    out = np.empty(max(last - first, 0))
    for begin in range(first, last, BLOCK):
        n = np.arange(begin, min(begin + BLOCK, last))
        left = n * down // up - width + 1  # of each output's own stretch
        low, high = int(left[0]), int(left[-1]) + 2 * width
        before, after = max(0, -low), max(0, high - length)
        if max(low, 0) < start or min(high, length) > start + len(samples):
            raise ValueError("the stretch is too short for these samples")
        own = np.concatenate([np.zeros(before), samples[max(low, 0) - start : min(high, length) - start], np.zeros(after)])
        windows = np.lib.stride_tricks.sliding_window_view(own, 2 * width)
        out[begin - first : begin - first + len(n)] = (windows[left - low] * taps[n % up]).sum(axis=1)
    return out


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    if rate == target or not len(samples):
        return samples
    n = -(-len(samples) * target // rate)
    return resampled_span(np.asarray(samples, np.float64), 0, len(samples), rate, target, 0, n)


def resample_parts(parts: DataFrame, recording: str, part: str, samples: str, rate: int, target: int) -> DataFrame:
    """Recordings that come in parts, a row each, resampled part by part: the rows with ``samples`` at the target
    rate. Put together in order of ``part`` they are, sample for sample, what the whole recording gives.

    The parts' places are running sums of their lengths. A part takes its filter's reach from its neighbours as
    short heads and tails, so a recording's length sets neither a task's memory nor its work; neighbours shorter
    than that reach are looked through, up to ``REACH`` of them on a side. A null part is empty.
    """
    if rate == target:
        return parts
    up, down, width, _ = filter_bank(rate, target)
    value = F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>"))
    order = Window.partitionBy(recording).orderBy(part)
    rows = parts.withColumns({"_x": value, "_n": F.size(value).cast("long")})
    rows = rows.withColumns({"_start": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), "_length": F.sum("_n").over(Window.partitionBy(recording))})
    heads = F.slice("_x", F.lit(1), F.lit(width))
    tails = F.slice("_x", F.greatest(F.size("_x") - width, F.lit(0)) + 1, F.lit(width))
    rows = rows.withColumns({"_heads": heads, "_tails": tails})
    around = lambda c, low, high: F.flatten(F.collect_list(c).over(order.rowsBetween(low, high)))
    rows = rows.withColumns({"_before": around("_tails", -REACH, -1), "_after": around("_heads", 1, REACH)}).drop("_heads", "_tails")

    def run(before: pa.Array, own: pa.Array, after: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for b, x, a, s, n in zip(before, own, after, start.to_pylist(), length.to_pylist(), strict=True):
            b, x, a = (v.values.to_numpy(zero_copy_only=False) for v in (b, x, a))
            first, last = -(-s * up // down), -(-(s + len(x)) * up // down)
            out.append(resampled_span(np.concatenate([b, x, a]), s - len(b), n, rate, target, first, last))
        return pa.array(out, pa.list_(pa.float64()))

    made = F.arrow_udf(run, "array<double>")("_before", "_x", "_after", "_start", "_length")
    return rows.select(*(F.when(F.col(c).isNotNull(), made).alias(c) if c == samples else F.col(c) for c in parts.columns))


def decode_wave(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as f:
        data, width = f.readframes(f.getnframes()), f.getsampwidth()
        if width == 3:  # as the upper three bytes of four
            three = np.frombuffer(data, np.uint8).reshape(-1, 3)
            data, width = np.concatenate([np.zeros((len(three), 1), np.uint8), three], axis=1).tobytes(), 4
        kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
        raw = np.frombuffer(data, kind).astype(np.float64)
        raw = (raw - 128) / 128 if kind is np.uint8 else raw / float(2 ** (8 * width - 1))
        return raw.reshape(-1, f.getnchannels()), f.getframerate()


Decoder = Callable[[bytes], tuple[np.ndarray, int]]


def waveform(audio: Column, target: int = 24000, rule: str = "second", decoders: Mapping[str, Decoder] | None = None) -> Column:
    """Samples at the target rate of an audio struct (array, bytes, path, sampling_rate); null where
    it can't be decoded. An array goes before bytes, bytes before the file at the path, which is a
    local path of the executors or a URI. Wave data is decoded here; ``decoders`` has what decodes other
    kinds, by the suffix of the path. ``fault`` tells which rows had audio and gave none."""
    known = dict(decoders or {})

    def one(array: pa.Scalar, data: pa.Scalar, path: str | None, rate: int | None) -> np.ndarray | None:
        try:
            if array.is_valid:
                samples, own = array.values.to_numpy(zero_copy_only=False).astype(np.float64), int(rate)
            elif data.is_valid or path is not None:
                suffix = os.path.splitext(path or "")[1].lower()
                samples, own = known.get(suffix, decode_wave)(data.as_py() if data.is_valid else read_file(path))
            else:
                return None
            return resample(mono(samples, rule), own, target)
        except (ValueError, TypeError, EOFError, KeyError, OSError, wave.Error):
            return None

    def run(array: pa.Array, data: pa.Array, path: pa.Array, rate: pa.Array) -> pa.Array:
        out = [one(*x) for x in zip(array, data, path.to_pylist(), rate.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(audio["array"], audio["bytes"], audio["path"], audio["sampling_rate"])


def read_file(path: str) -> bytes:
    where, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with where.open_input_stream(place) as f:
        return f.read()


def fault(audio: Column, wave_: Column) -> Column:
    """``no audio`` where there is none, ``cannot decode`` where it gave no samples; else null."""
    there = audio["array"].isNotNull() | audio["bytes"].isNotNull() | audio["path"].isNotNull()
    return F.when(~there, "no audio").when(wave_.isNull(), "cannot decode")


def duration(given: Column, wave_: Column, rate: int) -> Column:
    return F.coalesce(given, F.size(wave_) / F.lit(float(rate)))
