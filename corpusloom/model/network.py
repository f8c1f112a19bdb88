"""Convolutions, gated recurrent units and a linear layer over feature frames, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; layers: (channels, kernel, stride, padding) of each convolution."""

    mels: int = 80
    classes: int = 50
    layers: tuple[tuple[int, int, int, int], ...] = ((128, 3, 2, 1), (128, 3, 2, 1))
    hidden: int = 256

    def lengths(self, frames: int) -> int:
        for _, k, s, p in self.layers:
            frames = (frames + 2 * p - k) // s + 1
        return max(frames, 1)

    @property
    def stride(self) -> int:
        return int(np.prod([s for _, _, s, _ in self.layers]))

    def parameters(self) -> int:
        total, last = 0, self.mels
        for c, k, _, _ in self.layers:
            total, last = total + c * (last * k + 1), c
        return total + 3 * self.hidden * (last + self.hidden + 2) + self.classes * (self.hidden + 1)


@dataclass
class Network:
    """Weights: conv (w (out, in, kernel), b) a layer; gru w_in, w_h (3 * hidden, ...) in the order reset, update, new, with
    b_in and b_h; out_w, out_b. They are drawn at random unless given."""

    shape: Shape = field(default_factory=Shape)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    seed: int = 0

    def __post_init__(self) -> None:
        rng, last = np.random.default_rng(self.seed), self.shape.mels
        made: dict[str, np.ndarray] = {}
        draw = lambda *size: (rng.standard_normal(size) / np.sqrt(size[-1])).astype(np.float32)
        for i, (c, k, _, _) in enumerate(self.shape.layers):
            made[f"conv{i}_w"], made[f"conv{i}_b"], last = draw(c, last, k), np.zeros(c, np.float32), c
        h = self.shape.hidden
        made |= {"w_in": draw(3 * h, last), "w_h": draw(3 * h, h), "b_in": np.zeros(3 * h, np.float32), "b_h": np.zeros(3 * h, np.float32)}
        made |= {"out_w": draw(self.shape.classes, h), "out_b": np.zeros(self.shape.classes, np.float32)}
        self.weights = made | self.weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(frames, mels) to (encoder frames, classes)."""
        w = self.weights
        for i, (_, k, s, p) in enumerate(self.shape.layers):
            x = np.pad(x, ((p, max(p, k - p - len(x))), (0, 0)))
            seen = np.lib.stride_tricks.sliding_window_view(x, k, axis=0)[::s]  # (frames, in, kernel)
            x = np.maximum(np.einsum("tik,oik->to", seen, w[f"conv{i}_w"], optimize=True) + w[f"conv{i}_b"], 0)
        h, n = np.zeros(self.shape.hidden, np.float32), self.shape.hidden
        gates, out = x @ w["w_in"].T + w["b_in"], np.empty((len(x), n), np.float32)
        squash = lambda v: 1 / (1 + np.exp(-v))
        for t, g in enumerate(gates):
            own = w["w_h"] @ h + w["b_h"]
            reset, update = squash(g[:n] + own[:n]), squash(g[n : 2 * n] + own[n : 2 * n])
            new = np.tanh(g[2 * n :] + reset * own[2 * n :])
            h = (1 - update) * new + update * h
            out[t] = h
        return out @ w["out_w"].T + w["out_b"]


def score(features: DataFrame, network: Network) -> DataFrame:
    """(utt, tokens): the likeliest class of each encoder frame of (utt BIGINT, mels ARRAY<ARRAY<FLOAT>>); null for no frame."""
    spread = features.sparkSession.sparkContext.broadcast(network)  # a small model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spread.value.logits(np.array(m, np.float32)).argmax(1).tolist() if m else None for m in batch.column(1).to_pylist()]
            yield pa.record_batch({"utt": batch.column(0), "tokens": pa.array(made, pa.list_(pa.int32()))})

    return features.select("utt", "mels").mapInArrow(run, "utt long, tokens array<int>")


class LengthError(ValueError):
    """A model makes another number of frames than its shape says."""


def verify_lengths(network: Network, lengths: list[int]) -> None:
    """Holds the shape's arithmetic against what the layers make of silent clips of these lengths: each alone, and the
    longest as all of a padded batch are. No lengths, or a difference, raise LengthError with both numbers."""
    if not lengths:
        raise LengthError("there are no lengths to try")
    for frames in sorted(set(lengths)):
        said, made = network.shape.lengths(frames), len(network.logits(np.zeros((frames, network.shape.mels), np.float32)))
        if said != made:
            raise LengthError(f"of {frames} frames {said} should be left, the layers leave {made}")


def examples(features: DataFrame, encoded: DataFrame, key: str = "utt") -> DataFrame:
    """(key, mels, labels, frames, label_count): what a model is trained on, rows that have both features and labels.

    features: key, mels (array of frames); encoded: key, ids.
    """
    both = features.select(key, "mels").join(encoded.select(key, F.col("ids").alias("labels")), key)
    return both.where("size(mels) > 0 and size(labels) > 0").withColumns({"frames": F.size("mels"), "label_count": F.size("labels")})


def collated(rows: DataFrame, size: int, mels: int, blank: int = 0, key: str = "utt") -> DataFrame:
    """Adds batch, and fills mels with silent frames and labels with the blank up to the longest of the batch.

    A batch holds ``size`` examples of nearly the same length, in order of (frames, key), so little is filled up.
    """
    from pyspark.sql import Window

    from corpusloom.operators.grouped import global_rank

    ranked = global_rank(rows, [F.col("frames"), F.col(key)], "_rank").withColumn("batch", F.expr(f"(_rank - 1) div {size}"))
    w = Window.partitionBy("batch")
    held = ranked.withColumns({"_f": F.max("frames").over(w), "_l": F.max("label_count").over(w)})
    silent = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), mels), F.col("_f") - F.col("frames"))
    return held.withColumns({"mels": F.concat("mels", silent), "labels": pad_labels(F.col("labels"), F.col("_l"), blank)}).drop("_rank", "_f", "_l")


def pad_labels(labels: Column, length: Column, blank: int = 0) -> Column:
    """An array filled up to ``length`` with the blank."""
    return F.concat(labels, F.array_repeat(F.lit(blank), F.greatest(length - F.size(labels), F.lit(0))))
