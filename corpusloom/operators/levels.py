"""Levels, loudness and validity of waveforms (arrays of float), by higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import LevelLimits

NEGATIVE_INFINITY = float("-inf")


def dbfs(amplitude: Column) -> Column:
    return F.when(amplitude > 0, 20 * F.log10(amplitude)).otherwise(F.lit(NEGATIVE_INFINITY))


def amplitude(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 20)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, F.abs)).cast("double"), F.lit(0.0))


def _mean(samples: Column, of) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + of(x.cast("double")))
    return F.when(F.size(samples) > 0, total / F.size(samples)).otherwise(0.0)


def rms(samples: Column) -> Column:
    return F.sqrt(_mean(samples, lambda x: x * x))


def dc_offset(samples: Column) -> Column:
    return _mean(samples, lambda x: x)


def crest(samples: Column) -> Column:
    return F.when(rms(samples) > 0, peak(samples) / rms(samples)).otherwise(0.0)


def clipping_ratio(samples: Column, limit: float = 0.999) -> Column:
    """Share of samples at or above the limit; the limit is compared as a float, as the samples are."""
    over = F.size(F.filter(samples, lambda x: F.abs(x) >= F.lit(limit).cast("float")))
    return F.when(F.size(samples) > 0, over / F.size(samples)).otherwise(0.0)


def zero_crossing_rate(samples: Column) -> Column:
    """Changes of sign a sample; divided by all samples, 0 for fewer than two. Minus zero counts as negative."""
    negative = lambda x: (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    n = F.size(samples)
    ahead = F.slice(samples, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(samples, F.lit(1), F.greatest(n - 1, F.lit(0))), ahead, lambda a, b: F.when(negative(a) != negative(b), 1).otherwise(0))
    return F.when(n >= 2, F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / n).otherwise(0.0)


def frame_rms(samples: Column, frame: int | Column = 400, hop: int | Column = 160) -> Column:
    """RMS of frames of ``frame`` samples every ``hop``, numbers or columns of them; a rest shorter than a frame is dropped,
    a short clip is one frame."""
    if any(isinstance(n, int) and n <= 0 for n in (frame, hop)):
        raise ValueError("frame and hop must be positive")
    frame, hop = (F.lit(n) if isinstance(n, int) else n for n in (frame, hop))
    last = F.floor((F.size(samples) - frame) / hop).cast("int")
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: rms(F.slice(samples, i * hop + 1, frame)))
    one = F.array(rms(samples))
    return F.when(F.size(samples) == 0, F.array().cast("array<double>")).when(F.size(samples) < frame, one).otherwise(many)


def apply_gain(samples: Column, gain_db: Column) -> Column:
    """Samples times the gain, as float; 0 dB leaves them as they are, a gain that isn't finite raises."""
    factor = amplitude(gain_db)
    scaled = F.transform(samples, lambda x: (x.cast("double") * factor).cast("float"))
    bad = gain_db.isNull() | F.isnan(gain_db) | (F.abs(gain_db) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("the gain must be finite"))).when(gain_db == 0, samples).otherwise(scaled)


def _normalized(samples: Column, level: Column, target: float) -> Column:
    if not NEGATIVE_INFINITY < target < 0:
        raise ValueError("the target level must be finite and below 0 dBFS")
    silent = F.raise_error(F.lit("silence cannot be normalized"))
    return F.when(level > 0, apply_gain(samples, target - dbfs(level))).otherwise(silent)


def normalize_peak(samples: Column, target: float = -1.0) -> Column:
    return _normalized(samples, peak(samples), target)


def normalize_rms(samples: Column, target: float = -20.0) -> Column:
    return _normalized(samples, rms(samples), target)


def to_mono(frames: Column) -> Column:
    """Mean over the channels of each frame of an array of arrays, as float."""
    return F.transform(frames, lambda f: (F.aggregate(f, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(f)).cast("float"))


_ISSUE = "struct<code:string,severity:string,value:double>"


def _issues(*found: tuple[Column, str, str, Column]) -> Column:
    made = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))) for when, code, severity, value in found]
    return F.filter(F.array(*made), lambda i: i.isNotNull()).cast(f"array<{_ISSUE}>")


def validate(clips: DataFrame, limits: LevelLimits = LevelLimits(), samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """Adds issues (code, severity, value in order of the checks), ok, and peak, rms, dc_offset, crest_factor, duration,
    clipping_ratio, which are null where a check before them ends the inspection (no samples, values that aren't finite,
    a rate not above 0)."""
    x, sr = F.col(samples), F.col(rate)
    count = lambda f: F.size(F.filter(x, f))
    clips = clips.withColumns({"_nan": count(F.isnan), "_inf": count(lambda v: F.abs(v) == F.lit(float("inf")).cast("float"))})
    alive = (F.size(x) > 0) & (F.col("_nan") == 0) & (F.col("_inf") == 0) & (sr > 0)
    only = lambda c: F.when(alive, c)
    clips = clips.withColumns(
        {"peak": only(peak(x)), "rms": only(rms(x)), "dc_offset": only(dc_offset(x)), "duration": only(F.size(x) / sr), "clipping_ratio": only(clipping_ratio(x, limits.clipping))}
    ).withColumn("crest_factor", F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).when(F.col("rms") == 0, 0.0))
    filled = F.size(x) > 0
    issues = _issues(
        ((sr <= 0) | (sr < limits.min_rate) | (sr > limits.max_rate), "unsupported_sample_rate", "error", sr),
        (F.size(x) == 0, "empty", "error", F.lit(0.0)),
        (filled & (F.col("_nan") > 0), "nan", "error", F.col("_nan")),
        (filled & (F.col("_inf") > 0), "infinite", "error", F.col("_inf")),
        (F.col("duration") > limits.max_seconds, "too_long", "error", F.col("duration")),
        (F.col("duration") < limits.min_seconds, "empty", "error", F.col("duration")),
        (F.col("clipping_ratio") > limits.clipping_ratio, "clipped", "warning", F.col("clipping_ratio")),
        (F.col("rms") <= limits.silence_rms, "silent", "error", F.col("rms")),
        ((F.col("rms") > limits.silence_rms) & (F.col("rms") < limits.min_rms), "low_amplitude", "warning", F.col("rms")),
        (F.abs("dc_offset") > limits.dc_offset, "dc_offset", "warning", F.col("dc_offset")),
    )
    clips = clips.withColumn("issues", issues)
    return clips.withColumn("ok", ~F.exists("issues", lambda i: i["severity"] == "error")).drop("_nan", "_inf")


def loudness(clips: DataFrame, limits: LevelLimits = LevelLimits(), samples: str = "samples") -> DataFrame:
    """Adds peak, rms, dc_offset, crest_factor, peak_dbfs, rms_dbfs, clipping_ratio, loudness and loudness_issues.

    Silent, too quiet, too loud or normal by level; clipping overrides the label. An empty clip is silent without issue.
    """
    x = F.col(samples)
    clips = clips.withColumns({"peak": peak(x), "rms": rms(x), "dc_offset": dc_offset(x), "clipping_ratio": clipping_ratio(x, limits.clipping)})
    clips = clips.withColumns({"crest_factor": F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).otherwise(0.0), "peak_dbfs": dbfs(F.col("peak")), "rms_dbfs": dbfs(F.col("rms"))})
    level = (
        F.when(F.col("rms_dbfs") <= limits.silence_dbfs, "silent").when(F.col("rms_dbfs") < limits.quiet_dbfs, "too_quiet")
        .when(F.col("peak_dbfs") > limits.loud_dbfs, "too_loud").otherwise("normal")
    )
    clipped, filled = F.col("clipping_ratio") > limits.clipping_ratio, F.size(x) > 0
    issues = _issues(
        (filled & clipped, "clipped", "warning", F.col("clipping_ratio")), (filled & (level == "silent"), "silent", "error", F.col("rms_dbfs")),
        (filled & (level == "too_quiet"), "low_amplitude", "warning", F.col("rms_dbfs")), (filled & (level == "too_loud"), "too_loud", "warning", F.col("peak_dbfs")),
        (filled & (F.abs("dc_offset") > limits.dc_offset), "dc_offset", "warning", F.col("dc_offset")),
    )
    return clips.withColumn("loudness", F.when(clipped, "clipped").otherwise(level)).withColumn("loudness_issues", issues)


def summary(issues: Column) -> Column:
    """``code(severity); ...`` of an array of issues."""
    return F.array_join(F.transform(issues, lambda i: F.concat(i["code"], F.lit("("), i["severity"], F.lit(")"))), "; ")


def of_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda i: i["severity"] == severity)


def sine(seconds: float, hz: float, amp: float = 0.5, rate: int = 16_000) -> Column:
    """A test tone."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(round(seconds * rate), 1) - 1)), lambda i: (amp * F.sin(i * (2 * 3.141592653589793 * hz / rate))).cast("float"))


def speech_like(seconds: float, hz: float = 180.0, amp: float = 0.35, rate: int = 16_000) -> Column:
    """Six harmonics under a 4 Hz envelope."""
    step = 2 * 3.141592653589793 / rate
    tone = lambda i: sum((F.sin(i * (step * hz * k)) for k in range(1, 7)), F.lit(0.0)) / 6
    one = lambda i: (amp * tone(i) * (1 - F.cos(i * (step * 4))) / 2).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(max(round(seconds * rate), 1) - 1)), one)
