"""Follow-the-regularised-leader logistic regression over hashed features, and labelled samples for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_fold, keyed_text, map_slices

#: Labelled documents that a fit looks at; a documented bound, the same at every size.
TRAIN_ROWS = 6000


class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2 penalties; dense state over ``size`` buckets and a bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, which has no penalty

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bias = self.z[at], at == len(self.z) - 1
        l1 = np.where(bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(bias, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def step(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        square = gradient * gradient
        sigma = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * weights
        self.n[at] += square

    def learn(self, at: np.ndarray, value: np.ndarray, label: float, weight: float = 1.0) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        self.step(at, weight * (sigmoid(float(w @ value)) - label) * value, w)

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float64)


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Sample:
    """Labelled texts: features of all of them end to end, each feature of a text once, with how often it stands there."""

    label: np.ndarray
    size: np.ndarray  # of a text, as its features count it
    at: np.ndarray
    count: np.ndarray
    offsets: np.ndarray

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Label, size, features and counts of each text, as views."""
        for k, y in enumerate(self.label.tolist()):
            own = slice(self.offsets[k], self.offsets[k + 1])
            yield y, int(self.size[k]), self.at[own], self.count[own]

    @staticmethod
    def of(rows: list[tuple[int, tuple[int, np.ndarray]]]) -> Sample:
        made = [(y, size, *np.unique(at, return_counts=True)) for y, (size, at) in rows]
        join = lambda k: np.concatenate([r[k] for r in made]).astype(np.int32) if made else np.zeros(0, np.int32)
        return Sample(np.array([r[0] for r in made], np.int32), np.array([r[1] for r in made], np.int32), join(2), join(3), np.concatenate([[0], np.cumsum([len(r[2]) for r in made])]).astype(np.int64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, featurise: Callable[[bytes], tuple[int, np.ndarray]], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Sample:
    """At most ``rows`` labelled documents outside the held-out fold, in an order fixed by their ids.

    ``featurise`` gives a text's size and its features.  An id with several labels takes the
    largest, one with several texts that of the fewest words (of equals the one with the
least features); null labels and ids don't count.
    """
    one = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).dropna()
    chosen = one.filter(crc_fold("__id") != 1).groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(chosen), "__id")  # at most ``rows`` pairs of numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own = Sample.of([(y, featurise(t)) for y, t in zip(piece.column("__label").to_pylist(), as_bytes(piece.column("__text")), strict=True)])
        lists = [pa.ListArray.from_arrays(pa.array(own.offsets, pa.int32()), pa.array(x)) for x in (own.at, own.count)]
        return pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(own.label), pa.array(own.size), *lists], ["__id", "__label", "size", "at", "count"])

    sample = map_slices(texts.select("__id", "__label", "__text"), run, f"__id {kind}, __label int, size int, at array<int>, count array<int>")
    sample = sample.groupBy("__id").agg(F.min(F.struct("__label", "size", "at", "count")).alias("s")).orderBy(F.xxhash64("__id"), "__id").select("s.*")
    data = sample.toArrow().combine_chunks()
    if not data.num_rows:
        return Sample.of([])
    y, size, at, count = (x.chunk(0) for x in data.columns)
    return Sample(y.to_numpy(), size.to_numpy(), at.values.to_numpy(), count.values.to_numpy(), at.offsets.to_numpy())


def score_texts(df: DataFrame, score: Callable[[list[bytes]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id`` and ``score`` of every row; ``score`` takes the texts of a slice."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(score(as_bytes(piece.column("__text"))), pa.float64())], ["__id", "score"])

    return map_slices(keyed_text(df, id_col, text_col), run, f"__id {kind}, score double")
