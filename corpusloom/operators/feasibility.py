"""Whether an encoder has enough frames for the labels of an utterance, and what follows for a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions import text as tx
from corpusloom.operators.grouped import ranked_values

#: Time strides of encoders (fixed values).
STRIDES = (4, 8, 16, 32)
#: name -> number of labels of a raw text
UNITS: dict[str, Callable[[Column], Column]] = {
    "word": lambda t: F.size(tx.words(t)),
    "char_no_space": lambda t: F.length(tx.unspaced(t)),
    "char_with_space": F.length,
}
#: Characters a second from which a transcript is corrupt, and the range in which no violation may lie (fixed values).
CORRUPT_RATE, AMBIGUOUS = 60.0, (50.0, 95.0)


def stft_frames(seconds: Column, half_up: bool = False) -> Column:
    """1 + floor(samples / hop); samples are rounded half to even, or half up as SQL engines do it."""
    samples = seconds * schema.SAMPLE_RATE
    return (1 + F.floor((F.floor(samples + 0.5) if half_up else F.bround(samples)) / schema.HOP)).cast("int")


def encoder_frames(frames: Column, layers: int) -> Column:
    """``layers`` times half of it, rounded up; at least 1. For positive lengths that is one ceiling division."""
    return F.greatest(F.ceil(frames / float(2**layers)), F.lit(1)).cast("int")


def subsampled(frames: Column, layers: list[tuple[int, int, int]]) -> Column:
    """Length after convolutions of (kernel, stride, padding): floor((n + 2p - k) / s) + 1 each; at least 1."""
    for k, s, p in layers:
        frames = F.floor((frames + (2 * p - k)) / float(s)) + 1
    return F.greatest(frames, F.lit(1)).cast("int")


def per_stride(rows: DataFrame, units: dict[str, Callable[[Column], Column]] = UNITS, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """(unit, stride, utterances, violations, tight, ratio_min, ratio_p05, ratio_median) over utterances with labels.

    tight: enough frames, but fewer than two a label. p05 and median are the values at index n // 20 and n // 2.
    """
    frames = stft_frames(F.col("duration_seconds"), half_up=True)
    wide = rows.select(frames.alias("frames"), *[u(F.col("text")).alias(k) for k, u in units.items()])
    long = wide.select("frames", F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), F.col(k).alias("labels")) for k in units])).alias("u"))
    counted = long.where("u.labels > 0").groupBy("frames", "u.unit", "u.labels").count()  # far fewer rows from here on
    each = [F.struct(F.lit(s).alias("stride"), encoder_frames(F.col("frames"), s.bit_length() - 1).alias("have")) for s in strides]
    grid = counted.select("unit", "labels", "count", F.explode(F.array(*each)).alias("e")).select("unit", "labels", "count", "e.stride", "e.have")
    grid = grid.withColumn("ratio", F.col("have") / F.col("labels"))
    sums = grid.groupBy("unit", "stride").agg(
        F.sum("count").alias("utterances"), F.sum(F.when(F.col("have") < F.col("labels"), F.col("count")).otherwise(0)).alias("violations"),
        F.sum(F.when((F.col("have") >= F.col("labels")) & (F.col("ratio") < 2), F.col("count")).otherwise(0)).alias("tight"), F.min("ratio").alias("ratio_min"),
    )
    values = grid.groupBy("unit", "stride", "ratio").agg(F.sum("count").alias("count"))
    return sums.join(_weighted_ranks(values, ["unit", "stride"], "ratio", {"ratio_p05": "n div 20 + 1", "ratio_median": "n div 2 + 1"}), ["unit", "stride"])


def _weighted_ranks(values: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """Exact ranks over (keys, value, count) where a group has few distinct values."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    v = values.withColumns({"_to": F.sum("count").over(w.orderBy(value)), "n": F.sum("count").over(w)})
    at = lambda r: F.max(F.when((F.expr(r) <= F.col("_to")) & (F.expr(r) > F.col("_to") - F.col("count")), F.col(value)))
    return v.groupBy(*keys).agg(*[at(r).alias(name) for name, r in ranks.items()])


def labelled(rows: DataFrame, unit: str, stride: int = 4) -> DataFrame:
    """Adds labels, encoder_frames, rate (non-blank characters a second) and reason of a violation, else null."""
    layers = stride.bit_length() - 1
    out = rows.withColumns({"labels": UNITS[unit](F.col("text")), "encoder_frames": encoder_frames(stft_frames(F.col("duration_seconds"), half_up=True), layers)})
    out = out.withColumn("rate", F.length(tx.unspaced(F.col("text"))) / F.col("duration_seconds"))
    why = F.when(F.col("rate") >= CORRUPT_RATE, "corrupt_transcript").otherwise("fast_speech_below_encoder_resolution")
    return out.withColumn("reason", F.when(F.col("encoder_frames") < F.col("labels"), why))


def violations(rows: DataFrame, unit: str, stride: int = 4) -> DataFrame:
    return labelled(rows, unit, stride).where("reason is not null")


def training_guards(rows: DataFrame, unit: str = "char_with_space", stride: int = 4) -> DataFrame:
    """(name, ok, detail): rows with fewer encoder frames than labels, and rows without any label, of a training set.

    ``manifest.enforce`` raises if there are any.
    """
    held = labelled(rows, unit, stride).agg(F.count_if(F.col("reason").isNotNull()).alias("starved"), F.count_if(F.col("labels") == 0).alias("empty"))
    pairs = F.array(F.struct(F.lit("no row is starved of frames").alias("name"), F.col("starved").alias("detail")), F.struct(F.lit("no row is without labels").alias("name"), F.col("empty").alias("detail")))
    return held.select(F.explode(pairs).alias("c")).select("c.name", (F.col("c.detail") == 0).alias("ok"), "c.detail")


def length_probe(lengths: DataFrame, most: int = 12) -> DataFrame:
    """(frames): the distinct lengths to try a model on: the shortest and the longest, ``most`` in all, or all if they are
    no more."""
    distinct = lengths.select("frames").distinct()
    ends = distinct.orderBy("frames").limit(most // 2).unionByName(distinct.orderBy(F.col("frames").desc()).limit(most // 2))
    few = distinct.limit(most + 1).count() <= most
    return distinct if few else ends.distinct()


def corrupt(rows: DataFrame, unit: str = "char_no_space") -> DataFrame:
    return violations(rows, unit).where("reason = 'corrupt_transcript'")


def curated(rows: DataFrame) -> DataFrame:
    """The next version of a dataset: all rows but those with a corrupt transcript, nothing else changed."""
    return rows.join(corrupt(rows).select("row_id"), "row_id", "left_anti")


def rate_audit(rows: DataFrame, unit: str) -> DataFrame:
    """(split, utterances, p50, p95, p99, fastest, over_15, over_20, over_25, over_30) of labels a second.

    Percentiles are the values at index int(n * q); utterances without labels are left out.
    """
    rated = rows.select("split", UNITS[unit](F.col("text")).alias("labels"), "duration_seconds").where("labels > 0")
    rated = rated.withColumn("rate", F.col("labels") / F.col("duration_seconds"))
    at = {f"p{q}": f"cast(floor(n * {q / 100}D) as bigint) + 1" for q in (50, 95, 99)}
    values = ranked_values(rated, ["split"], "rate", at)
    over = rated.groupBy("split").agg(F.max("rate").alias("fastest"), *[F.count_if(F.col("rate") > k).alias(f"over_{k}") for k in (15, 20, 25, 30)])
    return values.withColumnRenamed("n", "utterances").join(over, "split")


def length_report(rows: DataFrame, unit: str) -> DataFrame:
    """(split, count, total, mean, median, longest) of label counts, empty texts included; the median is the upper one."""
    counted = rows.select("split", UNITS[unit](F.col("text")).alias("labels")).groupBy("split", "labels").count()
    sums = counted.groupBy("split").agg(
        F.sum("count").alias("count"), F.sum(F.col("labels") * F.col("count")).alias("total"), F.max("labels").cast("long").alias("longest")
    ).withColumn("mean", F.col("total") / F.col("count"))
    return sums.join(_weighted_ranks(counted, ["split"], "labels", {"median": "n div 2 + 1"}).withColumn("median", F.col("median").cast("long")), "split")
