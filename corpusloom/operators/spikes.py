"""Implausible measurements: spikes, stuck values and impossible readings, judged against each source's own rows.

Each source gets an isolation forest over four features of a reading: level (against the source's median), difference
to the reading before, seasonal residual (against the source's mean at that hour) and length of the run of equal
readings. The trees of the forest are grown from small random samples, as the method has it. The forest scores every
reading, and what score is unusual follows from the scores of all of the source's readings, exactly; explicit rules on
physical limits decide on what the score brings up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions.textform import filled_column
from corpusloom.operators.grouped import grouped_median, ranked_values
from corpusloom.session import broadcast_small, settle

FEATURES = ("level", "change", "season", "run")


@dataclass(frozen=True)
class SpikeConfig:
    """trees, sample: size of a forest and of the sample each tree is grown from; pool: most readings of a source that
    trees draw from; chunk: readings scored in one call; factor, run: the limits of the rules; calm: share of a source's
    readings within the limits that the forest must not bring up; rare: how often the distance from the median of their
    scores to that quantile a score lies beyond it to be isolated; few: readings of a source below which the limit alone
    decides, since a forest of two scores all alike and one of three has no usual reading to be calibrated to; span:
    utterance numbers ordered in one task."""

    trees: int = 32
    sample: int = 32
    pool: int = 512
    chunk: int = 20_000
    factor: float = 1.8
    run: int = 4
    calm: float = 0.75
    rare: float = 3.0
    few: int = 4
    span: int = 4096
    seed: int = 7


class Forest:
    """Isolation trees of equal height, kept as complete binary trees in arrays (tree, node)."""

    def __init__(self, x: np.ndarray, config: SpikeConfig, seed: int) -> None:
        rng = np.random.default_rng([config.seed, seed & 0x7FFFFFFF])
        n, width = x.shape
        psi, trees = min(config.sample, n), config.trees
        self.height = max(1, math.ceil(math.log2(max(psi, 2))))
        nodes = 2 ** (self.height + 1)
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.limit = np.zeros((trees, nodes))
        self.size = np.zeros((trees, nodes), np.int32)
        pick = np.argsort(rng.random((trees, n)), axis=1)[:, :psi]
        at, points, base = np.ones((trees, psi), np.int64), x[pick], np.arange(trees)[:, None] * nodes
        columns = [np.ascontiguousarray(points[..., j]).ravel() for j in range(width)]
        for depth in range(self.height + 1):
            flat = (base + at).ravel()
            self.size.reshape(-1)[:] += np.bincount(flat, minlength=trees * nodes).astype(np.int32)
            if depth == self.height:
                break
            first = (np.arange(trees)[:, None] * nodes + np.arange(2**depth, 2 ** (depth + 1))).ravel()  # nodes of this level
            low, high = np.full((width, trees * nodes), np.inf), np.full((width, trees * nodes), -np.inf)
            for j, column in enumerate(columns):
                np.minimum.at(low[j], flat, column)
                np.maximum.at(high[j], flat, column)
            low, high = low[:, first], high[:, first]
            f = np.where(high > low, rng.random(low.shape), -1.0).argmax(0)
            lo, hi = low[f, np.arange(len(f))], high[f, np.arange(len(f))]
            split, cut = hi > lo, rng.random(len(f))
            self.feature.reshape(-1)[first] = np.where(split, f, -1)
            lo, hi = np.where(split, lo, 0.0), np.where(split, hi, 0.0)
            self.limit.reshape(-1)[first] = lo + cut * (hi - lo)
            at = self._step(points, np.arange(trees * psi).reshape(trees, psi) * width, at, np.arange(trees)[:, None])
            at = np.where(at < 2 ** (depth + 1), 0, at)  # ended above; node 0 is not used
        self.usual = self._expected(np.array([psi]))[0]

    @staticmethod
    def _expected(n: np.ndarray) -> np.ndarray:
        """Mean path of an unsuccessful search among n points."""
        m = np.maximum(n, 2).astype(float)
        return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m) + (n < 2) * 0.0

    def _step(self, points: np.ndarray, points_at: np.ndarray, at: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """points: flat; points_at: where the features of each entry of ``at`` begin in it."""
        flat = at + tree * self.feature.shape[1]
        f = self.feature.reshape(-1)[flat]
        value = points.reshape(-1)[points_at + np.maximum(f, 0)]
        return np.where(f >= 0, 2 * at + (value >= self.limit.reshape(-1)[flat]), at)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; about 0.5 for usual points of a source, more for those set apart early."""
        tree = np.arange(len(self.limit))[None, :]
        at = np.ones((len(x), len(self.limit)), np.int64)
        x = np.ascontiguousarray(x)
        points_at = np.arange(len(x))[:, None] * x.shape[1]
        path = np.zeros_like(at)
        for _ in range(self.height):
            path += self.feature[tree, at] >= 0
            at = self._step(x, points_at, at, tree)
        depth = (path + self._expected(self.size[tree, at])).mean(1)
        return 2.0 ** (-depth / max(self.usual, 1e-9))


#: Columns that go through the scoring as they are.
_CARRIED = "row_id long, speaker long, duration double, ratio double, run_length long, n long, usual boolean"


def _scorer(config: SpikeConfig):
    carried = [c.split()[0] for c in _CARRIED.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
        x = np.clip(np.nan_to_num(x, nan=0.0, posinf=50.0, neginf=-50.0), -50.0, 50.0)
        grow, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("grow", "own"))
        order = np.argsort(table.column("row_id").to_numpy(zero_copy_only=False)[grow], kind="stable")  # the same forest in every piece and run
        pool, rows = x[grow][order], x[own]
        forest = Forest(pool, config, int(key[0].as_py())) if len(pool) else None
        score = np.concatenate([forest.score(rows[i : i + 4096]) for i in range(0, len(rows), 4096)]) if forest and len(rows) else np.zeros(len(rows))
        out = table.filter(pa.array(own)).select(carried)
        return pa.table({**{c: out.column(c) for c in carried}, "score": pa.array(score, pa.float64())})

    return run


def _limits(scored: DataFrame, config: SpikeConfig) -> DataFrame:
    """(speaker, cut, top): the quantile ``calm`` of the scores of all of a speaker's readings within the limits, and the score
    from which on a reading is isolated. A speaker without such readings has no row."""
    ranks = {name: f"cast(floor({q}D * (n - 1)) as long) + 1" for name, q in (("middle", 0.5), ("cut", config.calm))}
    held = ranked_values(scored.where("usual"), ["speaker"], "score", ranks)
    top = F.when(F.col("cut") > F.col("middle"), F.col("cut") + config.rare * (F.col("cut") - F.col("middle"))).otherwise(float("inf"))
    return held.select("speaker", "cut", top.alias("top"))


def _runs(rows: DataFrame, span: int) -> DataFrame:
    """(speaker, number, mark, before, run_length): the utterances with a duration in order of their numbers.

    A speaker's numbers are cut into spans of fixed width; runs are found within a span and then joined over its edges
    from one row per edge, so no task orders a whole speaker.
    """
    one = rows.where("speaker is not null and number is not null and duration is not null")
    one = one.groupBy("speaker", "number", "mark").agg(F.min_by("duration", "row_id").alias("d"))
    one = one.withColumn("part", F.expr(f"number div {span}"))
    w = Window.partitionBy("speaker", "part").orderBy("number", "mark")
    one = one.withColumn("lag", F.lag("d").over(w))
    one = one.withColumn("island", F.sum(F.when(F.col("lag") == F.col("d"), 0).otherwise(1)).over(w))
    one = one.withColumn("inner", F.count("*").over(Window.partitionBy("speaker", "part", "island")))
    pieces = one.groupBy("speaker", "part", "island").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    pieces = pieces.withColumn("last", F.max("island").over(Window.partitionBy("speaker", "part")))
    edges = pieces.where("island = 1 or island = last")
    w = Window.partitionBy("speaker").orderBy("part", "island")
    edges = edges.withColumns({"edge": F.lag("d").over(w), "from": F.lag("part").over(w)})
    same = (F.col("edge") == F.col("d")) & (F.col("from") != F.col("part"))
    edges = edges.withColumn("joint", F.sum(F.when(same, 0).otherwise(1)).over(w))
    edges = edges.withColumn("whole", F.sum("n").over(Window.partitionBy("speaker", "joint")))
    edges = edges.select("speaker", "part", "island", "whole", F.when(F.col("from") != F.col("part"), F.col("edge")).alias("edge"))
    one = one.join(edges, ["speaker", "part", "island"], "left")
    return one.select(
        "speaker", "number", "mark", F.coalesce("lag", F.when(F.col("island") == 1, F.col("edge"))).alias("before"),
        F.coalesce("whole", "inner").alias("run_length"),
    )


def _pieces(rows: DataFrame, config: SpikeConfig) -> DataFrame:
    """The readings to score with their piece of at most about ``chunk`` rows of a speaker (own), whatever their values, and
    in every piece the readings the forest is grown from (grow)."""
    hours = rows.where("hour is not null and abs(level) < 1").groupBy("speaker", "hour").agg(F.avg("level").alias("at_hour"))
    judged = rows.join(hours, ["speaker", "hour"], "left")
    judged = judged.withColumn("season", F.col("level") - F.coalesce("at_hour", F.lit(0.0)))
    # A reading is in the pool by its own number, never by its place, so reruns grow the same forests.
    draw = F.pmod(F.xxhash64("row_id", F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30)
    within = F.expr("duration > 0 and duration < double('inf')") & (F.abs("level") < math.log(config.factor)) & (F.coalesce("run_length", F.lit(1)) < config.run)
    judged = judged.withColumns(
        {"grow": draw < F.lit(float(config.pool)) / F.col("readings"), "chunks": F.ceil(F.col("readings") / config.chunk).cast("int"), "own": F.lit(True), "usual": within}
    ).withColumn("piece", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int"))
    more = judged.where("grow and chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    more = more.where("other <> piece").withColumns({"piece": F.col("other"), "own": F.lit(False)})
    wanted = ["piece", *[c.split()[0] for c in _CARRIED.split(", ")], "grow", "own", *FEATURES]
    return judged.select(*wanted).unionByName(more.select(*wanted))


def score_durations(manifest: DataFrame, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """One row per manifest row: row_id, speaker, duration_seconds, ratio, run_length, score, cut, reasons, flagged.

    ratio is characters per second over the speaker's median. cut is what the forest is calibrated to: that share
    ``calm`` of the speaker's own readings within the limits scores less. reasons holds ``impossible`` (not finite or not
    above 0), ``rate`` (brought up by a score above cut, and beyond the factor), ``stuck`` (a run of equal readings) and
    ``isolated`` (a score far beyond cut, by the spread of the scores within the limits), the last of which the forest alone
    decides. The limit alone decides on a rate for a speaker with fewer than ``few`` durations. A null duration is
    never flagged and has no score; neither has a row that names no speaker, which only the limit ``impossible`` judges.
    Rows without text have no ratio. Rows of one utterance count once in a run. Other columns of the table are ignored; an
    empty table gives an empty result.
    """
    base = manifest.select(
        "row_id",
        ids.speaker_number(F.col("speaker_id"), F.col("utterance_id")).alias("speaker"),
        ids.utterance_part(F.col("utterance_id"), 3).alias("number"),
        F.xxhash64(ids.utterance_key(F.col("utterance_id"))).alias("mark"),
        F.col("duration_seconds").alias("duration"),
        filled_column("text").alias("chars"),
        F.hour("recorded_at").alias("hour"),
    )
    base = settle(base, "readings")
    finite = F.expr("duration > 0 and duration < double('inf')")  # NaN is above infinity here
    rate = F.when(finite & (F.col("chars") > 0), F.col("chars") / F.col("duration"))
    rows = base.withColumns({"rate": rate, "log": F.when(finite, F.ln("duration"))})
    # One row a speaker: the readings there are to judge, usual rate and duration.
    judged = rows.where("speaker is not null and duration is not null").groupBy("speaker").agg(F.count("*").alias("readings"))
    medians = grouped_median(rows, "speaker", "rate").withColumnRenamed("median", "usual_rate")
    spans = grouped_median(rows, "speaker", "duration").select("speaker", F.col("median").alias("usual_duration"))
    speakers = settle(judged.join(spans, "speaker", "left").join(medians, "speaker", "left"), "speakers")
    rows = rows.join(_runs(rows, config.span), ["speaker", "number", "mark"], "left").join(broadcast_small(speakers), "speaker", "left")
    rows = rows.withColumns(
        {
            "ratio": F.col("rate") / F.col("usual_rate"),
            "level": F.coalesce(F.ln(F.col("rate") / F.col("usual_rate")), F.col("log") - F.ln("usual_duration"), F.lit(0.0)),
            "change": F.coalesce(F.when((F.col("before") > 0) & (F.col("before") < float("inf")), F.col("log") - F.ln("before")), F.lit(0.0)),
            "run": F.ln(F.coalesce("run_length", F.lit(1)).cast("double")),
        }
    )
    rows = settle(rows.select("row_id", "speaker", "duration", "hour", "ratio", F.col("run_length").cast("long").alias("run_length"), F.coalesce("n", F.lit(0)).alias("n"), "readings", "level", "change", "run"), "features")
    known = F.col("speaker").isNotNull() & F.col("duration").isNotNull()
    pieces = _pieces(rows.where(known), config).groupBy("speaker", "piece")
    scored = settle(pieces.applyInArrow(_scorer(config), f"{_CARRIED}, score double"), "scores")
    limits = broadcast_small(settle(_limits(scored, config), "limits"))
    scored = scored.join(limits, "speaker", "left").withColumns({"cut": F.coalesce("cut", F.lit(0.0)), "top": F.coalesce("top", F.lit(float("inf")))}).drop("usual")
    none = F.lit(None).cast("double")
    rest = rows.where(~known).select("row_id", "speaker", "duration", "ratio", "run_length", "n", none.alias("score"), none.alias("cut"), none.alias("top"))
    impossible = F.expr("duration is not null and not (duration > 0 and duration < double('inf'))")
    # Limits are compared with a slack of a few rounding errors, so that a ratio of exactly 1.8 counts.
    apart = (F.col("ratio") >= config.factor * (1 - 1e-12)) | (F.col("ratio") <= (1 + 1e-12) / config.factor)
    brought = (F.col("score") > F.col("cut")) | (F.col("n") < config.few)
    reasons = F.filter(
        F.array(
            F.when(impossible, F.lit("impossible")),
            F.when(brought & apart, F.lit("rate")),
            F.when(F.col("duration").isNotNull() & (F.col("run_length") >= config.run), F.lit("stuck")),
            F.when(F.col("score") > F.col("top"), F.lit("isolated")),
        ),
        lambda x: x.isNotNull(),
    )
    return scored.unionByName(rest).select(
        "row_id", "speaker", F.col("duration").alias("duration_seconds"), "ratio", "run_length", "score", "cut", reasons.alias("reasons"), (F.size(reasons) > 0).alias("flagged")
    )


def found_spikes(manifest: DataFrame, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """row_id of the readings that break a limit and, where the limit is one of rate, were brought up by the forest."""
    return score_durations(manifest, config).where(F.exists("reasons", lambda r: r != "isolated")).select("row_id")
