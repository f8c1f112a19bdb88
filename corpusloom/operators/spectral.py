"""Spectra of waveforms in Arrow batches: short-time transform, mel, quality figures, resampling, speech frames."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.config import SpeechRule, StftConfig

FLOOR = 1e-12


def window(name: str, n: int) -> np.ndarray:
    """A periodic Hann or Hamming window."""
    if n <= 0:
        raise ValueError("a window has at least one sample")
    weights = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46)}
    if name not in weights:
        raise ValueError(f"unknown window {name!r}")
    a, b = weights[name]
    return a - b * np.cos(2 * np.pi * np.arange(n) / n)


def _spectrum(x: np.ndarray, config: StftConfig) -> np.ndarray:
    """(frames, bins) in double precision; centred frames see the signal mirrored at its ends."""
    x = np.asarray(x, np.float32)
    if x.ndim != 1 or not len(x):
        raise ValueError("a waveform is one filled row of samples")
    if config.center:
        if len(x) <= config.n_fft // 2:
            raise ValueError("the waveform is too short for centred frames")
        x = np.pad(x, config.n_fft // 2, mode="reflect")
    elif len(x) < config.n_fft:
        raise ValueError("the waveform is shorter than a frame")
    w = np.zeros(config.n_fft)
    at = (config.n_fft - config.win_length) // 2
    w[at : at + config.win_length] = window(config.window, config.win_length)
    frames = np.lib.stride_tricks.sliding_window_view(x, config.n_fft)[:: config.hop_length]
    return np.fft.rfft(frames * w, axis=1)


def stft(x: np.ndarray, config: StftConfig = StftConfig()) -> np.ndarray:
    """(frames, bins), complex64."""
    return _spectrum(x, config).astype(np.complex64)


def hz_to_mel(hz: np.ndarray, htk: bool = True) -> np.ndarray:
    hz = np.asarray(hz, float)
    if htk:
        return 2595.0 * np.log10(1 + hz / 700.0)
    step = np.log(6.4) / 27
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) / step)


def mel_to_hz(mel: np.ndarray, htk: bool = True) -> np.ndarray:
    mel = np.asarray(mel, float)
    if htk:
        return 700.0 * (10 ** (mel / 2595.0) - 1)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def _triangles(config: StftConfig) -> np.ndarray:
    bins = np.linspace(0, config.sample_rate / 2, config.n_fft // 2 + 1)[:, None]
    edges = mel_to_hz(np.linspace(hz_to_mel(config.fmin), hz_to_mel(config.fmax), config.n_mels + 2))
    up = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def mel_bank(config: StftConfig = StftConfig()) -> np.ndarray:
    """(bins, mels): triangles of height 1 between evenly spaced mel edges."""
    return _triangles(config).astype(np.float32)


def log_mel(x: np.ndarray, config: StftConfig = StftConfig(), epsilon: float = 1e-6) -> np.ndarray:
    """(frames, mels), float32, worked out in double precision."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return np.log(power(_spectrum(x, config)) @ _triangles(config) + epsilon).astype(np.float32)


def flatness(spectrum: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of each row."""
    held = np.maximum(spectrum, FLOOR)
    return np.exp(np.log(held).mean(1)) / held.mean(1)


def spectral_stats(x: np.ndarray, rate: int, config: StftConfig, rolloff: float = 0.85) -> tuple[float, float, float, float]:
    """Centroid, bandwidth and roll-off in Hz and flatness, means over frames; 0 for clips too short to transform."""
    if len(x) <= config.n_fft // 2:
        return 0.0, 0.0, 0.0, 0.0
    size = np.abs(_spectrum(x, config))
    hz = np.linspace(0, rate / 2, config.n_fft // 2 + 1)
    total = np.maximum(size.sum(1), FLOOR)
    centre = (size * hz).sum(1) / total
    spread = np.sqrt((size * (hz - centre[:, None]) ** 2).sum(1) / total)
    grown = np.cumsum(size, 1)
    edge = hz[np.argmax(grown >= rolloff * grown[:, -1:], 1)]
    return float(centre.mean()), float(spread.mean()), float(edge.mean()), float(flatness(size).mean())


@lru_cache(maxsize=32)
def _filters(old: int, new: int, half: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Windowed-sinc filters of all places a new sample can have between two old ones: (phases, taps), the old sample at which
    each begins, and the taps before it."""
    cut, step = min(1.0, new / old), math.gcd(old, new)
    phases = np.arange(new // step) * old / new
    first = np.floor(phases).astype(np.int64)
    reach = math.ceil(half / cut)
    off = np.arange(-reach, reach + 1) - (phases - first)[:, None]
    return cut * np.sinc(cut * off) * (0.5 + 0.5 * np.cos(np.pi * np.clip(off / (reach + 1), -1, 1))), first, reach


def resample(x: np.ndarray, old: int, new: int, half: int = 32) -> np.ndarray:
    """Samples at another rate by a windowed-sinc filter; equal rates and empty clips come back untouched.

    New samples repeat their places between old ones, so there is one filter a place, applied to all its samples as views
    of the clip: memory stays near the clip's own, whatever its length. Rates without a common divisor have many places.
    """
    if old <= 0 or new <= 0:
        raise ValueError("rates must be positive")
    if old == new or not len(x):
        return x
    kernels, first, reach = _filters(old, new, half)
    n, jump = -(-len(x) * new // old), old // math.gcd(old, new)
    held = np.concatenate([np.zeros(reach), np.asarray(x, float), np.zeros(reach + jump)])
    seen = np.lib.stride_tricks.sliding_window_view(held, 2 * reach + 1)
    out = np.empty(n, np.float32)
    for phase, (kernel, begin) in enumerate(zip(kernels[:n], first, strict=False)):
        mine = out[phase :: len(kernels)]
        for at in range(0, len(mine), 1 << 14):
            part = mine[at : at + (1 << 14)]
            start = begin + at * jump
            part[:] = seen[start : start + (len(part) - 1) * jump + 1 : jump] @ kernel
    return out


def _clips(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int]]:
    """(utt, samples, rate) of a batch; samples are views of the batch's buffer. A null clip is empty."""
    lists = batch.column(1)
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    filled = lists.is_valid().to_numpy(zero_copy_only=False)
    for i, (utt, rate) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        yield utt, values[ends[i] : ends[i + 1]] if filled[i] else values[:0], rate


def _lots(batches: Iterator[pa.RecordBatch], samples: int = 1 << 22) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Clips of the batches in lots of about so many samples; one clip may be longer."""
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for batch in batches:
        for clip in _clips(batch):
            if held and size + len(clip[1]) > samples:
                yield held
                held, size = [], 0
            held.append(clip)
            size += len(clip[1])
    if held:
        yield held


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def quality(clips: DataFrame, config: StftConfig | None = None) -> DataFrame:
    """(utt, centroid, bandwidth, rolloff, flatness) of clips (utt BIGINT, samples ARRAY<FLOAT>, sample_rate INT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, *spectral_stats(x, r, config or StftConfig(sample_rate=r))) for u, x, r in _clips(batch)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(columns)], ["utt", "centroid", "bandwidth", "rolloff", "flatness"])

    return clips.select("utt", "samples", "sample_rate").mapInArrow(run, "utt long, centroid double, bandwidth double, rolloff double, flatness double")


def log_mel_frames(clips: DataFrame, config: StftConfig = StftConfig()) -> DataFrame:
    """(utt, frame, mel): log-mel vectors; clips too short to transform have no frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            made = [(u, log_mel(x, config)) for u, x, _ in lot if len(x) > config.n_fft // 2]
            counts = [len(m) for _, m in made]
            frames = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
            flat = np.concatenate([m for _, m in made]).astype(np.float32) if made else np.zeros((0, config.n_mels), np.float32)
            mels = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * config.n_mels, pa.int32()), pa.array(flat.ravel(), pa.float32()))
            yield pa.record_batch({"utt": pa.array(np.repeat(np.array([u for u, _ in made], np.int64), counts)), "frame": pa.array(frames), "mel": mels})

    return clips.select("utt", "samples", "sample_rate").mapInArrow(run, "utt long, frame int, mel array<float>")


def resampled(clips: DataFrame, rate: int = 16_000) -> DataFrame:
    """Clips at one rate. Only those of another rate go through Python."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            made = [resample(x, r, rate) for _, x, r in lot]
            yield pa.record_batch({"utt": pa.array([u for u, _, _ in lot], pa.int64()), "samples": _lists(made, pa.float32()), "sample_rate": pa.array([rate] * len(made), pa.int32())})

    held = clips.select("utt", "samples", F.col("sample_rate").cast("int").alias("sample_rate"))
    other = held.where(F.col("sample_rate") != rate).mapInArrow(run, "utt long, samples array<float>, sample_rate int")
    return held.where(F.col("sample_rate") == rate).unionByName(other)


def speech_frames(clips: DataFrame, rule: SpeechRule = SpeechRule(), points: int = 512) -> DataFrame:
    """(utt, frame, energy_db, flatness): what the frame windows of ``operators.frames`` decide on.

    The transform has ``points`` points, or the next power of two if a frame is longer. Clips too short for it have no frame.
    """
    grid = rule.grid
    size = max(points, 1 << (grid.frame - 1).bit_length())
    setting = StftConfig(n_fft=size, sample_rate=grid.rate, win_length=grid.frame, hop_length=grid.hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            made = [(u, power(_spectrum(x, setting))) for u, x, _ in lot if len(x) > size // 2]
            counts = [len(p) for _, p in made]
            every = np.concatenate([p for _, p in made]) if made else np.ones((0, size // 2 + 1))
            frames = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
            yield pa.record_batch(
                {
                    "utt": pa.array(np.repeat(np.array([u for u, _ in made], np.int64), counts)), "frame": pa.array(frames),
                    "energy_db": pa.array((10 * np.log10(every.sum(1) + FLOOR)).astype(float)), "flatness": pa.array(flatness(every).astype(float)),
                }
            )

    return clips.select("utt", "samples", "sample_rate").mapInArrow(run, "utt long, frame int, energy_db double, flatness double")


def detect_speech(clips: DataFrame, rule: SpeechRule = SpeechRule(), points: int = 512) -> DataFrame:
    """(utt, frame, is_speech): energy above the noise floor and not flat, smoothed, held over and cleared of short runs."""
    from pyspark.sql import functions as F

    from corpusloom.operators import frames as fr

    raw = fr.threshold(speech_frames(clips, rule, points), "energy_db", rule.floor, rule.above)
    if rule.flattest is not None:
        raw = raw.withColumn("is_speech", F.col("is_speech") & (F.col("flatness") < rule.flattest))
    raw = raw.select("utt", "frame", "is_speech")
    return fr.drop_short(fr.hangover(fr.majority(raw, rule.vote), rule.hold), rule.shortest)


def magnitude(spectrum: np.ndarray) -> np.ndarray:
    return np.abs(spectrum)


def power(spectrum: np.ndarray) -> np.ndarray:
    return spectrum.real**2 + spectrum.imag**2


def phase(spectrum: np.ndarray) -> np.ndarray:
    return np.angle(spectrum)


def dominant_frequency(x: np.ndarray, rate: int) -> float:
    """The frequency of the strongest bin of the whole clip under a Hann window."""
    return float(np.abs(np.fft.rfft(x * np.hanning(len(x)))).argmax() * rate / len(x))


def quality_report(clips: DataFrame, frame: float = 0.025, hop: float = 0.010, silence: float = -50.0, config: StftConfig | None = None) -> DataFrame:
    """One row a clip: its levels and loudness, estimated signal-to-noise ratio, silence ratio, zero-crossing rate and
    spectral figures. Levels stay in the JVM; only the spectrum goes through Python, and joins on utt, which must be unique.
    """
    from pyspark.sql import functions as F

    from corpusloom.operators import levels as lv

    x, sr = F.col("samples"), F.col("sample_rate")
    held = lv.loudness(clips.select("utt", "samples", "sample_rate"))
    held = held.withColumns({"duration": F.size(x) / sr, "num_samples": F.size(x), "zero_crossing_rate": lv.zero_crossing_rate(x)})
    whole = lambda seconds: F.greatest(F.bround(sr * seconds), F.lit(1)).cast("int")
    levels = lv.frame_rms(x, whole(frame), whole(hop))
    held = held.withColumn("_db", F.transform(levels, lv.dbfs))
    finite = F.array_sort(F.filter("_db", lambda v: v > float("-inf")))
    held = held.withColumn("_finite", finite)
    n = F.size("_finite")

    def percentile(q: float):
        at = (n - 1) * q
        low = F.floor(at).cast("int")
        a, b = F.element_at("_finite", low + 1), F.element_at("_finite", F.least(low + 2, n))
        return a + (b - a) * (at - low)

    snr = F.when(n > 0, F.greatest(percentile(0.9) - percentile(0.1), F.lit(0.0))).otherwise(0.0)
    quiet = F.when(F.size("_db") > 0, F.size(F.filter("_db", lambda v: v <= silence)) / F.size("_db")).otherwise(1.0)
    held = held.withColumns({"estimated_snr_db": snr, "silence_ratio": quiet}).drop("_db", "_finite", "samples")
    names = {"centroid": "spectral_centroid_hz", "bandwidth": "spectral_bandwidth_hz", "rolloff": "spectral_rolloff_hz", "flatness": "spectral_flatness"}
    return held.join(quality(clips, config).withColumnsRenamed(names), "utt")


def extract_features(clips: DataFrame, config: StftConfig = StftConfig()) -> DataFrame:
    """Log-mel frames of clips of any rate: those of another rate than the setting's are resampled first."""
    return log_mel_frames(resampled(clips, config.sample_rate), config)
