"""Splits in given proportions that keep together all records sharing an entity.

Connected components come from alternating large-star and small-star steps. The identifier of a component's first
entity is hashed into ranges of the splits that are fixed with the delivery in which it first came.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.session import settle

SPLITS = ("train", "dev", "test")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u")
    linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: BIGINT); component is the least node of it.

    Loops, repeated and null edges don't matter. No step collects a node's neighbours: each takes minima and joins them
    back, so a node with a third of all edges costs no more than its edges.
    """
    named = edges.where("a is not null and b is not null and a <> b")
    now = settle(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
    before = mark(now)
    while before[0]:
        now = settle(_stars(now), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()


def record_speakers(manifest: DataFrame) -> DataFrame:
    """(row_id, dataset_id, delivery, speaker, named): the speakers in speaker_id and in utterance_id, as numbers or null."""
    return manifest.select(
        "row_id", "dataset_id", "delivery", ids.first_number(F.col("speaker_id")).alias("speaker"), ids.utterance_part(F.col("utterance_id"), 2).alias("named")
    )


def speaker_components(manifest: DataFrame) -> DataFrame:
    rows = record_speakers(manifest)
    return components(rows.select(F.col("speaker").alias("a"), F.col("named").alias("b")))


def tied_speakers(manifest: DataFrame, members: int = 1024) -> DataFrame:
    """(speaker_a, speaker_b): every pair of different speakers of a component, as 7-digit text, speaker_a < speaker_b.

    A component is listed by one key for every ``members`` of its speakers.
    """
    found = settle(speaker_components(manifest), "components")
    spelled = lambda c: F.when(c < 10_000_000, F.lpad(c.cast("string"), 7, "0")).otherwise(c.cast("string"))
    parts = found.groupBy("component").agg(F.ceil(F.count("*") / members).cast("int").alias("parts"))
    both = found.join(parts, "component")
    left = both.select(F.col("node").alias("a"), "component", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    right = both.select(F.col("node").alias("b"), "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["component", "part"]).where("a < b")
    return pairs.select(spelled(F.col("a")).alias("speaker_a"), spelled(F.col("b")).alias("speaker_b"))


def latest_ratios(versions: DataFrame) -> dict[str, dict[str, float]]:
    """dataset -> split -> ratio of its latest version. The table holds a few rows a dataset version."""
    last = Window.partitionBy("dataset_id")
    number = F.regexp_extract("dataset_version", "([0-9]+)", 1).try_cast("bigint")
    rows = versions.withColumn("number", number).withColumn("top", F.max("number").over(last)).where("number = top")
    out: dict[str, dict[str, float]] = {}
    for r in rows.select("dataset_id", "split", "ratio").collect():
        out.setdefault(r["dataset_id"], {})[r["split"]] = r["ratio"]
    return out


#: Ratios of a dataset without version.
PLAIN = {"train": 0.9, "dev": 0.05, "test": 0.05}
#: Hash cells of a dataset, and the share of its smallest wanted split from which a component is placed by hand.
CELLS, HEAVY = 4096, 0.5


def cell_of(key: Column, seed: int) -> Column:
    """The hash cell of an identifier: 12 bits of MD5(identifier | seed)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 3), 16, 10).cast("int")


@dataclass
class SplitPlan:
    """Where components go by their heads: ends is (dataset, delivery) -> splits with the hash cells before which their
    ranges end, for heads that came with that delivery; placed is (dataset, head) -> split of the few too heavy for a range.
    A delivery adds entries and changes none."""

    ends: dict[tuple[str, int], list[tuple[str, int]]] = field(default_factory=dict)
    placed: dict[tuple[str, int], str] = field(default_factory=dict)

    def fit(self, delivery: int, wanted: dict[str, dict[str, float]], held: dict[tuple[str, str], int], heavy: list, cells: dict[tuple[str, int], int]) -> None:
        """Entries for the components that came with a delivery: wanted is dataset -> split -> rows up to it, held what the
        components before it hold of that, heavy rows of (dataset, head, n), and cells (dataset, cell) -> rows of the others."""
        for d, want in sorted(wanted.items()):
            splits = [s for s in SPLITS if want.get(s, 0) > 0]
            left = {s: want[s] - held.get((d, s), 0) for s in splits}
            for r in sorted((r for r in heavy if r["dataset"] == d), key=lambda r: (-r["n"], r["head"])):
                s = max(splits, key=lambda s: left[s])
                left[s] -= r["n"]
                self.placed[d, r["head"]] = s
            own = {c: n for (name, c), n in cells.items() if name == d}
            rest = [max(0.0, left[s]) for s in splits]
            if not sum(rest):
                rest = [want[s] for s in splits]
            scale, run, k, made = sum(own.values()) / sum(rest), 0.0, 0, []
            for cell in range(CELLS):
                while k < len(splits) - 1 and run + own.get(cell, 0) / 2 > scale * sum(rest[: k + 1]) * (1 + 1e-12):
                    made.append((splits[k], cell))
                    k += 1
                run += own.get(cell, 0)
            self.ends[d, delivery] = made + [(s, CELLS) for s in splits[k:]]

    def apply(self, heads: DataFrame) -> DataFrame:
        """Adds split to heads (head, first, dataset, cell); null for those of a delivery that isn't planned yet."""
        spark = heads.sparkSession
        by_hand = spark.createDataFrame([(d, h, s) for (d, h), s in self.placed.items()], "dataset string, head long, placed string")
        ranges = spark.createDataFrame([(d, k, [e for _, e in ends], [s for s, _ in ends]) for (d, k), ends in self.ends.items()], "dataset string, first int, ends array<int>, names array<string>")
        out = heads.join(F.broadcast(by_hand), ["dataset", "head"], "left").join(F.broadcast(ranges), ["dataset", "first"], "left")  # a few rows a dataset and delivery
        inside = F.element_at("names", F.size(F.filter("ends", lambda e: e <= F.col("cell"))) + 1)
        return out.withColumn("split", F.coalesce("placed", F.when(F.col("ends").isNotNull(), inside))).drop("placed", "ends", "names")


_LATE = (1 << 31) - 1  # a row without delivery comes last


def _heads(firsts: DataFrame, sizes: DataFrame, found: DataFrame, delivery: int, seed: int) -> DataFrame:
    """(component, head, first, dataset, n, cell) of the components up to a delivery.

    The head is the member that came first, of several the one with most rows then, then the least number; later deliveries
    change none of that, so a component gets another head only if it is joined to one with an older head.
    """
    rows = sizes.where(F.col("delivery") <= delivery).groupBy("node").agg(F.sum("n").alias("n"))
    nodes = firsts.where(F.col("first") <= delivery).join(rows, "node").join(found, "node", "left")
    nodes = nodes.groupBy(F.coalesce("component", "node").alias("component"))
    heads = nodes.agg(F.min(F.struct("first", (-F.col("n_first")).alias("m"), "node", "dataset")).alias("h"), F.sum("n").alias("n"))
    return heads.select("component", F.col("h.node").alias("head"), "h.first", "h.dataset", "n", cell_of(F.col("h.node"), seed).alias("cell"))


def split_rows(manifest: DataFrame, versions: DataFrame, seed: int = 11) -> DataFrame:
    """(row_id, dataset_id, component, split) for every row.

    Rows tied by a speaker get one split. Deliveries are taken one after the other: components that came with one are
    hashed into ranges of its own, which end where their rows fill what the splits lack of the wanted proportions by then,
    and what came before keeps its split. So a row's split doesn't change as deliveries are added, unless its component is
    joined to one with an older head. Components with more rows than half of the smallest split's share are placed first,
    the largest first, each in the split that lacks most (at most a few dozen a dataset and delivery). A component belongs
    to the dataset its head came with first. A split of ratio 0 gets no row, a row without any speaker stands for itself, a
    null dataset is one of its own, and a dataset without version or without a ratio above 0 uses 0.9, 0.05, 0.05. Spark jobs run when this is called:
    a few for each delivery, over one row a speaker.
    """
    ratios = latest_ratios(versions)
    rows = record_speakers(manifest).withColumns({"dataset": F.coalesce("dataset_id", F.lit("")), "delivery": F.coalesce("delivery", F.lit(_LATE)).cast("int")})
    rows = rows.withColumn("node", F.coalesce("named", "speaker", -1 - F.col("row_id")))
    rows = settle(rows.select("row_id", "dataset_id", "dataset", "delivery", "node", F.coalesce("speaker", "node").alias("other")), "rows")
    named = F.explode(F.array_distinct(F.array("node", "other"))).alias("named")
    sizes = rows.select(named, "node", "dataset", "delivery", "row_id").groupBy(F.col("named").alias("node"), "dataset", "delivery")
    sizes = settle(sizes.agg(F.count_if(F.col("named") == F.col("node")).alias("n"), F.min("row_id").alias("row_id")), "sizes")
    first = F.min(F.struct("delivery", "row_id", "dataset")).alias("f")
    firsts = sizes.groupBy("node").agg(first).select("node", F.col("f.delivery").alias("first"), "f.dataset")
    counts = sizes.join(firsts.select("node", "first"), "node").where("delivery = first").groupBy("node").agg(F.sum("n").alias("n_first"))
    firsts = settle(firsts.join(counts, "node"), "firsts")
    links = settle(rows.where("node <> other").groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.min("delivery").alias("delivery")), "links")
    linked = {r["delivery"] for r in links.select("delivery").distinct().collect()}
    plan, found, heads = SplitPlan(), components(links.where("false").select("a", "b")), None
    for delivery in sorted(r["delivery"] for r in sizes.select("delivery").distinct().collect()):
        if delivery in linked:
            found = settle(components(links.where(F.col("delivery") <= delivery).select("a", "b")), "components")
        heads = _heads(firsts, sizes, found, delivery, seed)
        known = settle(plan.apply(heads), "heads")
        held = {(r["dataset"], r["split"]): r["n"] for r in known.groupBy("dataset", "split").agg(F.sum("n").alias("n")).collect()}
        wanted = {}
        for d in {d for d, _ in held}:
            want = {s: max(ratios.get(d, PLAIN).get(s) or 0.0, 0.0) for s in SPLITS}
            want = want if sum(want.values()) > 0 else PLAIN
            total = sum(n for (name, _), n in held.items() if name == d)
            wanted[d] = {s: total * r / sum(want.values()) for s, r in want.items()}
        most = manifest.sparkSession.createDataFrame([(d, HEAVY * min(v for v in want.values() if v > 0)) for d, want in wanted.items()], "dataset string, most double")
        new = known.where("split is null").join(F.broadcast(most), "dataset")
        heavy = new.where("n > most").select("dataset", "head", "n").collect()  # at most 2 / smallest ratio a dataset
        cells = {(r["dataset"], r["cell"]): r["n"] for r in new.where("n <= most").groupBy("dataset", "cell").agg(F.sum("n").alias("n")).collect()}  # at most CELLS a dataset
        plan.fit(delivery, wanted, held, heavy, cells)
    if heads is None:
        return manifest.sparkSession.createDataFrame([], "row_id long, dataset_id string, component long, split string")
    given = plan.apply(heads).select("component", "split")
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(given, "component").select("row_id", "dataset_id", "component", "split")
