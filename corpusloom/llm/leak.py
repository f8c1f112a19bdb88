"""Passages of evaluation texts inside a corpus, by winnowed fingerprints.

Of every window of ``window`` successive word k-grams the least hash is kept, so two texts that share k + window - 1
words in a row keep at least one fingerprint at the same place of the shared words. Fingerprints are joined, and each
hit is extended word by word on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import textform as tf
from corpusloom.session import settle

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class LeakConfig:
    """words: length from which a shared run counts; k: words of a gram; known: most distinct fingerprints of the
    evaluation texts that are sent to all workers (8 bytes each) to drop other fingerprints before the join. Beyond it
    the join itself finds the documents, in two passes."""

    words: int = 8
    k: int = 5
    known: int = 2_000_000

    @property
    def window(self) -> int:
        return self.words - self.k + 1


class WordHashes:
    """64-bit hashes of words, with a cache of bounded size."""

    def __init__(self, most: int = 500_000) -> None:
        self.held: dict[str, int] = {}
        self.most = most

    def of(self, words: list[str]) -> list[int]:
        held = self.held
        if len(held) > self.most:
            held.clear()
        out = []
        for w in words:
            h = held.get(w)
            if h is None:
                h = held[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return out


def fingerprints(counts: np.ndarray, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept k-grams of texts laid end to end; counts: words of each text."""
    n = len(hashes)
    if n < k + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for i in range(k):
        gram = gram * _MIX + np.concatenate([hashes[i:], np.zeros(i, np.uint64)])
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(29)
    ends = np.repeat(np.cumsum(counts), counts)
    here = np.arange(n)
    gram[here + k > ends] = _LAST
    least, place = gram.copy(), here.copy()
    for i in range(1, window):
        after = np.concatenate([gram[i:], np.full(i, _LAST)])
        later = after <= least  # of equal ones the last, in both texts
        place = np.where(later, here + i, place)
        least = np.minimum(least, after)
    full = here + k + window - 1 <= ends
    kept = np.unique(place[full])
    return kept, gram[kept]


def _emit(config: LeakConfig, known=None, context: bool = True):
    """Rows (id, gram, place, near) of the fingerprints of texts; near: hashes of the words around, -(words-k) to words."""
    reach = config.words - config.k
    width = 2 * reach + config.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        wanted = known.value if known is not None else None
        for batch in batches:
            words = [cache.of(tf.words(t)) for t in batch.column(1).to_pylist()]
            counts = np.array([len(w) for w in words], np.int64)
            hashes = np.fromiter((h for w in words for h in w), np.uint64, int(counts.sum()))
            place, gram = fingerprints(counts, hashes, config.k, config.window)
            if wanted is not None and len(place):
                at = np.minimum(np.searchsorted(wanted, gram), max(len(wanted) - 1, 0))
                keep = wanted[at] == gram if len(wanted) else np.zeros(len(gram), bool)
                place, gram = place[keep], gram[keep]
            starts = np.cumsum(counts) - counts
            text = np.searchsorted(np.cumsum(counts), place, side="right")
            columns = {
                "id": batch.column(0).take(pa.array(text)), "gram": pa.array(gram.view(np.int64)),
                "place": pa.array((place - starts[text]).astype(np.int32) if len(place) else np.zeros(0, np.int32)),
            }
            if context:
                at = place[:, None] + np.arange(-reach, width - reach)
                inside = (at >= starts[text][:, None]) & (at < (starts + counts)[text][:, None])
                near = np.where(inside, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))] if len(hashes) else 0, 0).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), width).cast(pa.list_(pa.int64()))
                columns["near"] = lists
            yield pa.record_batch(columns)

    return run


_ROW = "id long, gram long, place int"
_NEAR = _ROW + ", near array<long>"


def leak_hits(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, doc_from, doc_to, item_from): stretches of equal words around each joined fingerprint.

    Each reaches at most words - k beyond the gram on both sides, which decides whether at least ``words`` words agree.
    documents: doc_id, text; items: item_id, text.
    """
    asked = items.select(F.col("item_id").alias("id"), "text").mapInArrow(_emit(config), _NEAR)
    asked = settle(asked, "asked")
    docs = documents.select(F.col("doc_id").alias("id"), "text")
    grams = asked.select("gram").distinct()
    if grams.limit(config.known + 1).count() <= config.known:
        kept = np.sort(grams.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
        held = documents.sparkSession.sparkContext.broadcast(kept)
        found = docs.mapInArrow(_emit(config, held), _NEAR)
    else:
        hit = docs.mapInArrow(_emit(config, context=False), _ROW).join(grams, "gram", "left_semi").select("id").distinct()
        found = docs.join(hit, "id", "left_semi").mapInArrow(_emit(config), _NEAR)
    pairs = found.select(F.col("id").alias("doc_id"), "gram", F.col("place").alias("d"), F.col("near").alias("a")).join(
        asked.select(F.col("id").alias("item_id"), "gram", F.col("place").alias("i"), F.col("near").alias("b")), "gram"
    )
    reach, k = config.words - config.k, config.k
    same = lambda j: (F.col("a")[j] == F.col("b")[j]) & (F.col("a")[j] != 0)
    left = right = F.lit(0)
    for j in range(reach):  # from the far end inwards: only an unbroken run counts
        left = F.when(same(j), left + 1).otherwise(0)
        right = F.when(same(2 * reach + k - 1 - j), right + 1).otherwise(0)
    middle = same(reach)
    for j in range(reach + 1, reach + k):
        middle = middle & same(j)
    pairs = pairs.where(middle).withColumns({"l": left, "r": right})
    return pairs.select("doc_id", "item_id", (F.col("d") - F.col("l")).alias("doc_from"), (F.col("d") + k + F.col("r")).alias("doc_to"), (F.col("i") - F.col("l")).alias("item_from"))


def leaked(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``words`` successive words of an item.

    Words are compared in consistent form without case and punctuation. Null, empty and shorter texts hold nothing;
    repeated rows give one pair.
    """
    return leak_hits(documents, items, config).where(F.col("doc_to") - F.col("doc_from") >= config.words).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, words, doc_from, item_from): the longest shared run of each leaking pair; of equal ones the first."""
    hits = leak_hits(documents, items, config).withColumn("shift", F.col("doc_from") - F.col("item_from")).distinct()
    w = Window.partitionBy("doc_id", "item_id", "shift").orderBy("doc_from", "doc_to")
    before = F.max("doc_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("run", F.when(F.col("doc_from") <= before, 0).otherwise(1))
    hits = hits.withColumn("run", F.sum("run").over(w))
    runs = hits.groupBy("doc_id", "item_id", "shift", "run").agg(F.min("doc_from").alias("doc_from"), F.max("doc_to").alias("to"))
    runs = runs.withColumn("words", F.col("to") - F.col("doc_from")).where(F.col("words") >= config.words)
    best = F.min_by(F.struct("words", "doc_from", (F.col("doc_from") - F.col("shift")).alias("item_from")), F.struct(-F.col("words"), F.col("doc_from"), F.col("shift")))
    return runs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.words", "b.doc_from", "b.item_from")
