"""Speaker-disjoint splits by a greedy fold over speakers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.config import SplitRatios


def greedy(sizes: list[tuple[str, int]], ratios: SplitRatios) -> list[tuple[str, str]]:
    """Each speaker in turn to the split that lacks most utterances, the earlier of equal ones."""
    total = sum(n for _, n in sizes)
    missing = {s: r * total for s, r in ratios.items()}
    out = []
    for speaker, n in sizes:
        split = max(schema.SPLITS, key=lambda s: missing[s])
        missing[split] -= n
        out.append((speaker, split))
    return out


def plan(rows: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int = 1337, hashed: bool = False) -> DataFrame:
    """(speaker_id, utterances, split). Targets are shares of utterances.

    Speakers come in the order of Python's seeded shuffle of their sorted ids, or with ``hashed`` in that of
    md5(seed|speaker), which SQL can repeat. The fold needs the speakers' counts in order and runs on the driver: one row
    a speaker, never the utterances. An empty table raises ValueError.
    """
    counts = [(r["speaker_id"], r["n"]) for r in rows.groupBy("speaker_id").agg(F.count("*").alias("n"), F.md5(F.concat(F.lit(f"{seed}|"), "speaker_id")).alias("m")).orderBy("m" if hashed else "speaker_id").collect()]
    if not counts:
        raise ValueError("there are no utterances to split")
    if not hashed:
        random.Random(seed).shuffle(counts)
    sizes = dict(counts)
    made = [(s, sizes[s], split) for s, split in greedy(counts, ratios)]
    return rows.sparkSession.createDataFrame(made, "speaker_id string, utterances long, split string")


def assign(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with the split of their speaker instead of the one they came with."""
    return rows.drop("split").join(planned.select("speaker_id", "split"), "speaker_id")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("utterances"), F.count_distinct("speaker_id").alias("speakers"))
