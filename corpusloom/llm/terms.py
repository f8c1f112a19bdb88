"""How often every term occurs in a whole collection, and in how many records.

Blocks of records number their own terms and count them in arrays. A global integer dictionary is made of the blocks'
terms; with it the blocks' arrays are encoded, and the arrays are summed by ranges of identifiers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import settle

_PIECES = regex.compile(r"[^\p{White_Space}]+")
#: Distinct terms a block holds at most (but for those of one record).
BLOCK_TERMS = 200_000
#: Identifiers of a range: the length of the arrays that are summed.
RANGE = 1 << 16


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each block with its count arrays; a null term says how many records hold any."""
    total, rows, filled = Counter(), Counter(), 0

    def handed():
        terms = [None, *total]
        made = pa.record_batch(
            {
                "term": pa.array(terms, pa.string()), "times": pa.array([filled, *total.values()], pa.int64()),
                "records": pa.array([filled, *(rows[t] for t in total)], pa.int64()),
            }
        )
        total.clear(), rows.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            pieces = _PIECES.findall(text) if text else ()
            if not pieces:
                continue
            filled += 1
            total.update(pieces)
            rows.update(set(pieces))
            if len(total) >= BLOCK_TERMS:
                yield handed()
                filled = 0
    yield handed()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the encoded counts of one range after the other; rows come in order of their ranges."""
    now, times, records = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

    def summed():
        held = np.flatnonzero(times)
        made = pa.record_batch({"term_id": pa.array(held + now * RANGE), "times": pa.array(times[held]), "records": pa.array(records[held])})
        times[:], records[:] = 0, 0
        return made

    for batch in batches:
        ids, t, r = (batch.column(i).to_numpy() for i in range(3))
        ranges = ids // RANGE
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if now is not None and now != ranges[a]:
                yield summed()
            now = ranges[a]
            np.add.at(times, ids[a:b] % RANGE, t[a:b])
            np.add.at(records, ids[a:b] % RANGE, r[a:b])
    if now is not None:
        yield summed()


def count_blocks(records: DataFrame, text: str) -> DataFrame:
    """(term, times, records): the distinct terms of every block with their counts there, written once.

    Terms are the pieces between characters of the Unicode property White_Space, as stored. Null, empty and blank texts
    hold none. A row without term gives the records of a block that hold one.
    """
    return settle(records.select(F.col(text)).mapInArrow(_count_blocks, "term string, times long, records long"), "blocks")


def dictionary(blocks: DataFrame) -> DataFrame:
    """(term_id, term): all terms of the blocks, numbered from 0 without gaps; every partition owns a range of numbers.

    The terms are written once with their places, so a number stays the same if a partition is read again.
    """
    placed = blocks.where("term is not null").select("term").distinct().withColumn("_m", F.monotonically_increasing_id())
    placed = settle(placed.select("term", F.shiftright("_m", 33).alias("part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "dictionary")
    starts, at = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((r["part"], at))
        at += r["n"]
    first = placed.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.join(F.broadcast(first), "part").select((F.col("start") + F.col("place")).alias("term_id"), "term")


def count_terms(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """(term_id, term, times, records): the blocks' counts encoded with the dictionary and summed by ranges of identifiers.

    A task holds the arrays of one range at a time, whatever the number of terms or blocks.
    """
    encoded = blocks.join(numbered, "term").select("term_id", "times", "records")
    ranges = F.expr(f"term_id div {RANGE}")
    encoded = encoded.repartition(ranges).sortWithinPartitions(ranges)
    sums = encoded.mapInArrow(_sum_ranges, "term_id long, times long, records long")
    return sums.join(numbered, "term_id").select("term_id", "term", "times", "records")


def with_text(blocks: DataFrame) -> int:
    """The records of the blocks whose text is neither null nor blank."""
    return blocks.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def mark_terms(counts: DataFrame, filled: int, rare: int = 1, common: float = 0.05) -> DataFrame:
    """Adds mark: ``rare`` for terms in at most ``rare`` records, ``common`` for those in at least that share of the
    ``filled`` records, else null. A term that is both (a collection of one record) is rare."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.lit(common) * filled, "common")
    return counts.withColumn("mark", mark)
