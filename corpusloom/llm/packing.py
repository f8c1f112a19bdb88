"""Items of varying length in containers of fixed capacity, with little unused space.

Lengths are rounded up to classes. A window (a container or an even part of it) is filled by combinations of at most
three classes; non-negative least squares finds how often each combination is to be repeated so that together they use
up the histogram of classes. The repeats are rounded down and what is left of the histogram is packed greedily. All of
this happens on histograms, one for each dataset and plan; the items then only look up the place that their rank in
their class has been given.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators.grouped import grouped_median
from corpusloom.session import settle


@dataclass(frozen=True)
class PackConfig:
    """classes: length classes of a window; slack: classes a combination may leave unused; wanted: mean items of a
    window; block: items placed in one call."""

    classes: int = 480
    slack: int = 1
    wanted: float = 2.6
    block: int = 20_000


def combinations(classes: int, slack: int) -> np.ndarray:
    """Rows of three classes (0: none), in falling order, that fill a window but for ``slack``."""
    rows = []
    for total in range(classes - slack, classes + 1):
        for a in range((total + 2) // 3, total + 1):
            for b in range((total - a + 1) // 2, min(a, total - a) + 1):
                rows.append((a, b, total - a - b))
    return np.array(rows, np.int64)


def least_squares(columns: np.ndarray, wanted: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |sum of x[j] * (counts of columns[j]) - wanted|, by the active set method.

    columns: rows of three class numbers, 0 for none; wanted: figures by class, wanted[0] unused. If ``rounds`` are not
    enough, a RuntimeWarning says so; the repeats found so far are still of use.
    """
    x, target = np.zeros(len(columns)), wanted.astype(float).copy()
    target[0] = 0.0
    if not len(columns):
        return x
    active: list[int] = []
    dense, gram, z = np.zeros((len(target), 0)), np.zeros((0, 0)), np.zeros(0)
    tolerance = 1e-9 * max(1.0, np.abs(target).max())
    for _ in range(rounds):
        left = target - dense @ x[active]
        left[0] = 0.0
        slope = left[columns].sum(1)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            return x
        column = np.bincount(columns[j], minlength=len(target)).astype(float)
        column[0] = 0.0
        side = dense.T @ column
        gram = np.block([[gram, side[:, None]], [side[None, :], column @ column]])
        dense, active = np.column_stack([dense, column]), [*active, j]
        while True:
            z = np.linalg.solve(gram + 1e-10 * np.eye(len(active)), dense.T @ target)
            if (z > 0).all():
                x[:] = 0.0
                x[active] = z
                break
            now, bad = x[active], z <= 0
            step = min(1.0, float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min()))
            now = now + step * (z - now)
            keep = now > 1e-12 * max(1.0, now.max())
            x[:] = 0.0
            active = [a for a, k in zip(active, keep, strict=True) if k]
            x[active] = now[keep]
            dense, gram = dense[:, keep], gram[np.ix_(keep, keep)]
            if not active:
                break
    warnings.warn(f"least squares ended after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return x


def plan_containers(counts: dict[int, int], classes: int, parts: int, slack: int = 1) -> tuple[list[tuple], int]:
    """Ranges (class, first rank, end rank, items a unit, first unit, units a container) and the number of containers.

    counts: items by class, of 1 to classes * parts. Units are windows (``parts`` a container) or whole containers. Where
    filling containers greedily takes fewer of them than windows and greedy filling of what is left, no windows are made.
    """
    ranges, made = _plan(counts, classes, parts, slack)
    plain, fewer = _plan(counts, classes, parts, None)
    return (plain, fewer) if fewer < made else (ranges, made)


def _plan(counts: dict[int, int], classes: int, parts: int, slack: int | None) -> tuple[list[tuple], int]:
    """``plan_containers``, with windows that leave ``slack`` classes or without any (None)."""
    capacity = classes * parts
    left = np.zeros(capacity + 1, np.int64)
    for c, n in counts.items():
        left[c] = n
    combos = combinations(classes, slack) if slack is not None else np.zeros((0, 3), np.int64)
    combos = combos[(left[combos] > 0).all(1, where=combos > 0)] if len(combos) else combos
    total = max(int(left[: classes + 1].sum()), 1)
    repeats = np.floor(least_squares(combos, left[: classes + 1] / total) * total + 1e-9).astype(np.int64)
    windows: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-repeats, kind="stable"):
        used, need = np.unique(combos[j][combos[j] > 0], return_counts=True)
        n = min(int(repeats[j]), *(int(v) for v in left[used] // need)) if repeats[j] else 0
        if n > 0:
            left[used] -= n * need
            windows.append((combos[j], n))
    over = sum(n for _, n in windows) % parts
    while over and windows:  # windows that would not fill a container
        combo, n = windows.pop()
        back = min(over, n)
        used, need = np.unique(combo[combo > 0], return_counts=True)
        left[used] += back * need
        over -= back
        if n > back:
            windows.append((combo, n - back))
    ranges, rank, unit = [], np.zeros(capacity + 1, np.int64), 0
    for combo, n in windows:
        used, need = np.unique(combo[combo > 0], return_counts=True)
        for c, m in zip(used.tolist(), need.tolist(), strict=True):
            ranges.append((c, int(rank[c]), int(rank[c] + n * m), m, unit, parts))
            rank[c] += n * m
        unit += n
    made = unit // parts
    alive = [int(c) for c in np.nonzero(left)[0][::-1]]
    while alive:
        room, mix = capacity, []
        for c in alive:
            m = min(int(left[c]), room // c)
            if m:
                mix.append((c, m))
                room -= m * c
            if not room:
                break
        n = min(int(left[c]) // m for c, m in mix)
        for c, m in mix:
            ranges.append((c, int(rank[c]), int(rank[c] + n * m), m, made, 1))
            rank[c] += n * m
            left[c] -= n * m
        made += n
        alive = [c for c in alive if left[c]]
    return ranges, made


_GROUP = ["dataset_id", "plan_id"]
_RANGES = "dataset_id string, plan_id int, class int, first long, end long, per long, unit long, parts long"


def _planner(config: PackConfig):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        cut = group[group["class"] == 0]
        rest = group[group["class"] > 0]
        ranges, made = plan_containers(dict(zip(rest["class"], rest["n"], strict=True)), config.classes, int(group["parts"].iloc[0]), config.slack)
        if len(cut):  # whole containers of items that are longer than one
            ranges.append((0, 0, int(cut["n"].sum()), 1, made, 1))
        out = pd.DataFrame(ranges, columns=["class", "first", "end", "per", "unit", "parts"])
        out.insert(0, "plan_id", group["plan_id"].iloc[0])
        out.insert(0, "dataset_id", group["dataset_id"].iloc[0])
        return out

    return run


def _placer(config: PackConfig):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table, chunks: pa.Table) -> pa.Table:
        items = items.sort_by([("dataset_id", "ascending"), ("item", "ascending"), ("row_id", "ascending")])
        seconds, row = items["seconds"].to_numpy(), items["row_id"].to_numpy()
        name, data = items["item"].to_pylist(), np.array(items["dataset_id"].to_pylist(), object)
        c = chunks.to_pandas()
        out: list[tuple] = []
        for (dataset, plan, capacity, parts), part in c.groupby(["dataset_id", "plan_id", "capacity", "container_parts"], sort=True):
            own = np.nonzero(data == dataset)[0]
            d = seconds[own]
            whole, rest, cls = classify(d, capacity, int(parts), config.classes)
            part = part.sort_values(["class", "first"])
            before = part.groupby("class")["before"].first()
            order = np.argsort(cls, kind="stable")
            sorted_cls = cls[order]
            start = np.searchsorted(sorted_cls, sorted_cls)  # first item of the class in this block
            rank = before.reindex(sorted_cls).to_numpy() + np.arange(len(order)) - start
            body = part[part["class"] > 0]
            key_of = lambda k, r: k.astype(np.int64) * (1 << 44) + r.astype(np.int64)
            at = np.searchsorted(key_of(body["class"].to_numpy(), body["first"].to_numpy()), key_of(sorted_cls, rank), side="right") - 1
            at_first, per, unit, units = (body[k].to_numpy()[at] for k in ("first", "per", "unit", "parts"))
            container = (unit + (rank - at_first) // per) // units
            who = own[order]
            out.append((plan, dataset, container, who, whole[order], rest[order]))
            if whole.any():
                cut = part[part["class"] == 0].iloc[0]
                many = np.repeat(np.arange(len(own)), whole)
                number = np.arange(len(many))
                piece = number - np.repeat(np.cumsum(whole) - whole, whole)
                out.append((plan, dataset, cut["unit"] + cut["before"] + number, own[many], piece, np.full(len(many), capacity)))
        build = lambda i: np.concatenate([np.asarray(o[i]) for o in out]) if out else np.zeros(0)
        who = build(3).astype(np.int64)
        return pa.table(
            {
                "plan_id": pa.array(np.concatenate([np.full(len(o[3]), o[0]) for o in out]) if out else [], pa.int32()),
                "dataset_id": pa.array([data[i] for i in who], pa.string()), "container": pa.array(build(2).astype(np.int64)),
                "utterance": pa.array([name[i] for i in who], pa.string()), "row_id": pa.array(row[who] if len(row) else np.zeros(0, np.int64)),
                "part": pa.array(build(4).astype(np.int32)), "seconds": pa.array(build(5).astype(float)),
            }
        )

    return run


def classify(seconds: np.ndarray, capacity: float, parts: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole containers an item fills, what remains of it, class of the remainder)."""
    whole = np.maximum(np.ceil(seconds / capacity) - 1, 0).astype(np.int64)
    rest = np.minimum(seconds - whole * capacity, capacity)
    step = capacity / (parts * classes)
    return whole, rest, np.clip(np.ceil(rest / step * (1 + 1e-12)), 1, parts * classes).astype(np.int64)


def pack(items: DataFrame, plans: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """(plan_id, dataset_id, container, utterance, row_id, part, seconds): every item in every plan's containers.

    items: dataset_id, item, row_id, seconds; plans: plan_id, capacity_seconds. Containers are numbered by dataset and plan.
    An item not longer than the capacity is one part. A longer one fills containers of its own and its remainder is packed
    like an item. Lengths that are null, not finite or not above 0 and plans without a capacity above 0 are left out.
    """
    spark = items.sparkSession
    good = items.where("seconds > 0 and seconds < double('inf')")
    rows = good.select(F.coalesce("dataset_id", F.lit("")).alias("dataset_id"), "item", "row_id", F.col("seconds").cast("double").alias("seconds"))
    rows = settle(rows, "items")
    total = rows.count()
    blocks = max(1, -(-total // config.block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "row_id"), F.lit(blocks)).cast("int"))
    # The usual length ignores what no container can hold; a mean of values beyond it would be ruled by a few errors.
    usual = grouped_median(rows, "dataset_id", "seconds").withColumnRenamed("median", "usual")
    wanted = {r["plan_id"]: r["capacity_seconds"] for r in plans.where("capacity_seconds > 0").select("plan_id", "capacity_seconds").collect()}  # settings
    each = [F.struct(F.lit(k).cast("int").alias("plan_id"), F.lit(float(v)).alias("capacity")) for k, v in sorted(wanted.items())]
    empty = F.array().cast("array<struct<plan_id:int,capacity:double>>")
    grid = usual.select("dataset_id", "usual", F.explode(F.array(*each) if each else empty).alias("p")).select("dataset_id", "usual", "p.*")
    windows = F.greatest(F.lit(1), F.round(F.col("capacity") / (F.col("usual") * config.wanted))).cast("int")
    grid = settle(grid.withColumn("container_parts", windows), "grid")
    every = rows.join(grid, "dataset_id")
    whole = F.greatest(F.ceil(F.col("seconds") / F.col("capacity")) - 1, F.lit(0)).cast("long")
    every = every.withColumn("whole", whole).withColumn("rest", F.least(F.col("seconds") - F.col("whole") * F.col("capacity"), F.col("capacity")))
    top = F.col("container_parts") * config.classes
    cls = F.least(F.greatest(F.ceil(F.col("rest") / (F.col("capacity") / top) * (1 + 1e-12)), F.lit(1)), top).cast("int")
    every = every.withColumn("class", cls)
    keys = [*_GROUP, "capacity", "container_parts"]
    counts = every.groupBy(*keys, "class", "block").agg(F.count("*").alias("n"))
    cuts = every.where("whole > 0").groupBy(*keys, "block").agg(F.sum("whole").alias("n")).withColumn("class", F.lit(0))
    counts = settle(counts.unionByName(cuts), "counts")
    before = Window.partitionBy(*_GROUP, "class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = counts.groupBy(*_GROUP, F.col("container_parts").alias("parts"), "class").agg(F.sum("n").alias("n"))
    groups = max(1, min(1000, grid.count()))  # a task for each dataset and plan, as planning takes seconds
    ranges = settle(histogram.repartition(groups, *_GROUP).groupBy(*_GROUP).applyInPandas(_planner(config), _RANGES), "ranges")
    chunks = placed.alias("p").join(ranges.alias("r"), [*_GROUP, "class"])
    chunks = chunks.where("r.first < p.before + p.n and r.end > p.before")
    chunks = chunks.select("block", *_GROUP, "capacity", "container_parts", "class", "before", "first", "per", "unit", "parts")
    schema = "plan_id int, dataset_id string, container long, utterance string, row_id long, part int, seconds double"
    return rows.groupBy("block").cogroup(chunks.groupBy("block")).applyInArrow(_placer(config), schema)


def utterances(manifest: DataFrame) -> DataFrame:
    """(dataset_id, item, row_id, seconds): one row per utterance with a possible duration, that of its last delivery."""
    rows = manifest.where("duration_seconds > 0 and duration_seconds < double('inf')")
    key = F.coalesce(ids.utterance_key(F.col("utterance_id")), F.concat(F.lit("ROW_"), F.col("row_id").cast("string")))
    last = F.max_by(F.struct("row_id", F.col("duration_seconds").alias("seconds")), F.struct("delivery", "row_id"))
    return rows.groupBy("dataset_id", key.alias("item")).agg(last.alias("l")).select("dataset_id", "item", "l.row_id", "l.seconds")


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, dataset_id, containers, seconds, unused_share, most, cut_containers, filled_containers, filled_unused_share):
    how well the containers are filled.

    cut_containers hold a whole piece cut from an utterance longer than a container and waste nothing; a few implausibly
    long readings can make them nearly all. The last two columns are of the other containers, whose filling is the packing.
    """
    one = packed.join(F.broadcast(plans.select("plan_id", "capacity_seconds")), "plan_id")
    each = one.groupBy("plan_id", "dataset_id", "container", "capacity_seconds").agg(F.sum("seconds").alias("s"), F.count("*").alias("n"))
    cut = (F.col("n") == 1) & (F.col("s") >= F.col("capacity_seconds"))
    unused = lambda when: 1 - F.sum(F.when(when, F.col("s"))) / F.sum(F.when(when, F.col("capacity_seconds")))
    return each.groupBy("plan_id", "dataset_id").agg(
        F.count("*").alias("containers"), F.sum("s").alias("seconds"), unused(F.lit(True)).alias("unused_share"), F.max(F.col("s") / F.col("capacity_seconds")).alias("most"),
        F.count_if(cut).alias("cut_containers"), F.count_if(~cut).alias("filled_containers"), unused(~cut).alias("filled_unused_share"),
    )
