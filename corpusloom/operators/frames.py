"""Frame decisions and segments, one row a frame or segment, by windows over each utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns: utt (any type), frame (from 0, without gaps), is_speech.


def _order(utt: str = "utt") -> Window:
    return Window.partitionBy(utt).orderBy("frame")


def majority(frames: DataFrame, width: int) -> DataFrame:
    """is_speech by majority over ``width`` frames (an even width is one more); beyond the ends the end values repeat."""
    if width <= 1:
        return frames
    k = width // 2
    w, whole = _order().rowsBetween(-k, k), Window.partitionBy("utt")
    m = F.col("is_speech").cast("int")
    n = F.count("*").over(whole)
    ends = [F.min_by(m, "frame").over(whole), F.max_by(m, "frame").over(whole)]
    missing = [F.greatest(k - F.col("frame"), F.lit(0)), F.greatest(k - (n - 1 - F.col("frame")), F.lit(0))]
    votes = F.sum(m).over(w) + missing[0] * ends[0] + missing[1] * ends[1]
    return frames.withColumn("is_speech", votes > k)


def hangover(frames: DataFrame, more: int) -> DataFrame:
    """Every speech run goes on for ``more`` frames."""
    if more <= 0:
        return frames
    last = F.last(F.when(F.col("is_speech"), F.col("frame")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("is_speech", F.coalesce(F.col("is_speech") | (F.col("frame") - last <= more), F.lit(False)))


def _runs(frames: DataFrame) -> DataFrame:
    before = F.lag("is_speech").over(_order())
    new = F.when(before.eqNullSafe(F.col("is_speech")), 0).otherwise(1)
    return frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_order())).drop("_new")


def drop_short(frames: DataFrame, least: int) -> DataFrame:
    """Speech runs of fewer than ``least`` frames become silence."""
    if least <= 1:
        return frames
    size = F.count("*").over(Window.partitionBy("utt", "_run"))
    return _runs(frames).withColumn("is_speech", F.col("is_speech") & (size >= least)).drop("_run")


def threshold(frames: DataFrame, energy: str, percentile: float, margin: float) -> DataFrame:
    """Adds is_speech: energy above the utterance's noise floor (interpolated percentile of its finite energies) + margin."""
    finite = frames.where(F.abs(energy) < float("inf"))
    floor = finite.groupBy("utt").agg(F.percentile(energy, percentile / 100).alias("floor"))
    return frames.join(floor, "utt", "left").withColumn("is_speech", F.coalesce(F.col(energy) > F.col("floor") + margin, F.col(energy) > float("-inf"))).drop("floor")


def segments(frames: DataFrame, hop: int | float, frame: int | float | None = None) -> DataFrame:
    """(utt, start, end) of the speech runs: start of the first frame, end of the last one, of length ``frame`` (default hop)."""
    if hop <= 0:
        raise ValueError("hop must be positive")
    last = hop if frame is None else frame
    runs = _runs(frames).where("is_speech").groupBy("utt", "_run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return runs.select("utt", (F.col("a") * hop).alias("start"), (F.col("b") * hop + last).alias("end"))


def merge(parts: DataFrame, gap: int | float) -> DataFrame:
    """(utt, start, end): segments at most ``gap`` apart (inclusive) become one, in order of their starts."""
    w = Window.partitionBy("utt").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - reach <= gap, 0).otherwise(1)
    grouped = parts.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return grouped.groupBy("utt", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def pad(parts: DataFrame, by: int | float, total: Column | None = None) -> DataFrame:
    """Segments longer by ``by`` on both sides, within [0, total]. A total before a start raises."""
    end = F.col("end") + by
    end = end if total is None else F.least(end, total)
    start = F.greatest(F.col("start") - by, F.lit(0))
    return parts.withColumns({"start": start, "end": F.when(end >= start, end).otherwise(F.raise_error(F.lit("a segment ends before it starts")))})


def long_enough(parts: DataFrame, least: int | float) -> DataFrame:
    return parts.where(F.col("end") - F.col("start") >= least)


def build_segments(frames: DataFrame, hop: float = 0.010, frame: float = 0.025, gap: float = 0.20, by: float = 0.05, least: float = 0.10, total: Column | None = None) -> DataFrame:
    """Runs to segments, merged over gaps, padded, merged where padding made them meet, short ones dropped."""
    return long_enough(merge(pad(merge(segments(frames, hop, frame), gap), by, total), 0.0), least)


def overlaps(left: DataFrame, right: DataFrame, width: float = 5.0) -> DataFrame:
    """(utt, seconds): time in which segments of both sides overlap, by utterance.

    Segments meet on (utt, time cell of ``width`` seconds) instead of an inequality alone; a pair that shares several
    cells is counted in the first.
    """
    cells = lambda df, p: df.select("utt", F.col("start").alias(f"{p}s"), F.col("end").alias(f"{p}e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("cell"))
    met = cells(left, "a").join(cells(right, "b"), ["utt", "cell"]).where("as < be and bs < ae")
    met = met.where(F.col("cell") == F.greatest(F.floor(F.col("as") / width), F.floor(F.col("bs") / width)))
    return met.groupBy("utt").agg(F.sum(F.least("ae", "be") - F.greatest("as", "bs")).alias("seconds"))


def touching(start: Column, end: Column, other_start: Column, other_end: Column, tolerance: float = 0.0) -> Column:
    """Whether two segments overlap or are at most ``tolerance`` apart; ends belong to a segment."""
    return (start <= other_end + tolerance) & (other_start <= end + tolerance)


def frame_times(frame: Column, hop: int, rate: int) -> Column:
    """The second at which a frame begins."""
    return frame * (hop / rate)


def agreement(found: DataFrame, truth: DataFrame, margin: float = 0.0, rate: int = 16_000, width: float = 5.0) -> DataFrame:
    """(utt, coverage, leakage, beyond): how detected segments agree with true ones, counted in samples.

    coverage is the share of true samples that are detected (0 without any), leakage the share of detected samples that
    are not true, beyond that of detected samples further than ``margin`` seconds from any true one (1 without detected
    ones). Segments are seconds and are cut to whole samples downwards; those of one side may overlap.
    """

    def samples(df: DataFrame, more: float = 0.0) -> DataFrame:
        cut = df.select("utt", F.floor(F.greatest(F.col("start") - more, F.lit(0.0)) * rate).alias("start"), F.floor((F.col("end") + more) * rate).alias("end"))
        return merge(cut.where("end > start"), 0)

    size = lambda df, name: df.groupBy("utt").agg(F.sum(F.col("end") - F.col("start")).alias(name))
    shared = lambda a, b, name: overlaps(a, b, width * rate).withColumnRenamed("seconds", name)
    seen, real = samples(found), samples(truth)
    out = found.select("utt").unionByName(truth.select("utt")).distinct()
    for part in (size(seen, "seen"), size(real, "real"), shared(seen, real, "both"), shared(seen, samples(truth, margin), "near")):
        out = out.join(part, "utt", "left")
    out = out.fillna(0, ["seen", "real", "both", "near"])
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(F.lit(none))
    return out.select(
        "utt", share(F.col("both"), F.col("real"), 0.0).alias("coverage"), share(F.col("seen") - F.col("both"), F.col("seen"), 1.0).alias("leakage"),
        share(F.col("seen") - F.col("near"), F.col("seen"), 1.0).alias("beyond"),
    )


def greedy_decode(steps: DataFrame, blank: int = 0) -> DataFrame:
    """(utt, ids): tokens (utt, frame, token) without repeats of the step before and without blanks, in order."""
    kept = steps.withColumn("_b", F.lag("token", 1, -1).over(_order())).where((F.col("token") != F.col("_b")) & (F.col("token") != blank))
    grouped = kept.groupBy("utt").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "token"))), lambda s: s["token"]).alias("ids"))
    return steps.select("utt").distinct().join(grouped, "utt", "left").select("utt", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
