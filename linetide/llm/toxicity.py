"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences: words, pairs of neighbours, and pairs with one word between them, each
hashed to one of 2^20 coordinates.  Every coordinate has its own rate, and the L1 term keeps a
weight at exactly zero until its gradients add up, so what is broadcast is the few
coordinates with a weight, at most as many as there are coordinates.

The model is fitted on a bounded sample, at most :data:`SAMPLE` labelled documents of each label; every
document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import Memo, arrow_map, kept, two_columns, written
from .sampling import least_hashes, remainder, text_of

#: Labelled documents of each label that the fit takes at most.
SAMPLE = 4000
FOLDS, HELD_OUT = 5, 0
BITS = 20
EPOCHS = 3
#: Coordinates of a document in one row at most, while the fit reads them.
PIECE = 1024
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: Odd multipliers of the hashes of pairs.
_NEXT, _SKIP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def _word_hashes(chunk: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh64_intdigest(w) for w in _WORD.findall(chunk.lower()))


class Features:
    """Coordinates of a text, from a memo of its chunks' word hashes."""

    def __init__(self) -> None:
        self.memo = Memo(_word_hashes, 150_000)

    def __call__(self, text: str) -> np.ndarray:
        """All coordinates of a text, with repeats."""
        h = np.fromiter(chain.from_iterable(map(self.memo.__getitem__, text.split())), dtype=np.uint64)
        shift = np.uint64(64 - BITS)
        parts = [h >> shift]
        if len(h) > 1:
            parts.append(((h[:-1] * _NEXT + h[1:]) * _LAST) >> shift)
        if len(h) > 2:
            parts.append(((h[:-2] * _SKIP + h[2:]) * _LAST) >> shift)
        return np.concatenate(parts).astype(np.int64)


@dataclass
class Weights:
    """A fitted model: coordinates with a weight, and the bias (last coordinate is not hashed)."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.at] = self.weight
        return out


class Learner:
    """FTRL-proximal state of every coordinate: all that a fit holds besides one document."""

    def __init__(self, share: float, l1: float):
        size = (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.l1 = np.full(size, l1)
        self.l1[-1] = 0
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.cost = {1: 0.5 / share, 0: 0.5 / (1 - share)}

    def weights(self, at: np.ndarray) -> np.ndarray:
        own, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int) -> None:
        """One example: its distinct coordinates and its label."""
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * self.cost[label]
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w

    def model(self) -> Weights:
        every = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(every[:-1])
        return Weights(at, every[at], float(every[-1]))


#: What is known without examples: every score is near 0.
UNLEARNED = Weights(np.zeros(0, dtype=np.int64), np.zeros(0), -8.0)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over ``(distinct coordinates, label)`` in the given order; without examples every score is near 0."""
    if not examples:
        return UNLEARNED
    own = Learner(sum(y for _, y in examples) / len(examples), L1)
    for _ in range(epochs):
        for features, label in examples:
            own.learn(features, label)
    return own.model()


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> Weights:
    """Fits on at most ``most`` documents of each label, none of the held-out fold.

    Labels other than 0 and 1, and null ids, are left out; an id with several labels is toxic if one
    of them is, an id counts once however often it is repeated, and of its texts the least is taken.  The sample is the
    documents with the least hashes of their ids, read in the order of other hashes: by the same ones a rarer label would be left
    over at the end.  The fit reads the written coordinates of all epochs as one sorted stream, in rows of :data:`PIECE`
    at most, so it holds the state of the coordinates and one document, however long the documents are.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(remainder(id_col, FOLDS) != HELD_OUT).groupBy(F.col(id_col).alias("own")).agg(F.max(label_col).cast("int").alias("label"))
    ids = documents.select(F.col(id_col).alias("own")).where(F.col(id_col).isNotNull()).distinct()
    sample = least_hashes(marked.join(ids, "own", "left_semi"), "label", "own", most)
    texts = documents.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = text_of(texts, sample, ["own"]).select(F.xxhash64("own", F.lit("order")).alias("mark"), F.col("own").cast("string").alias("name"), "text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for mark, name, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.unique(of(text)).astype(np.int32)
                cuts = [found[k : k + PIECE] for k in range(0, max(1, len(found)), PIECE)]
                columns = [pa.array([mark] * len(cuts), pa.int64()), pa.array([name] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([label] * len(cuts), pa.int32()), pa.array(cuts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "name", "piece", "label", "features"])

    found = written(rows.mapInArrow(features, "mark bigint, name string, piece int, label int, features array<int>"), "features")
    seen = {r["label"]: r["n"] for r in found.where("piece = 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return UNLEARNED
    share = seen.get(1, 0) / sum(seen.values())
    epochs = found.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    read = epochs.repartition(1).sortWithinPartitions("epoch", "mark", "name", "piece").select("piece", "label", "features")
    model = read.mapInArrow(_trained(share, L1), "at int, weight double").toPandas().sort_values("at")
    return Weights(model["at"].to_numpy(dtype=np.int64)[1:], model["weight"].to_numpy()[1:], float(model["weight"].iloc[0]))


def _trained(share: float, l1: float):
    """All epochs over the sorted pieces of documents: the coordinates with a weight, and the bias as number -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Learner(share, l1)
        held: list[np.ndarray] = []
        label = 0
        for batch in batches:
            values, ends = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for k, (piece, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if piece == 0:
                    if held:
                        own.learn(np.concatenate(held), label)
                    held, label = [], y
                held.append(values[ends[k] : ends[k + 1]].astype(np.int64))
        own.learn(np.concatenate(held), label)
        w = own.model()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *w.at.tolist()], pa.int32()), pa.array([w.bias, *w.weight.tolist()], pa.float64())], ["at", "weight"])

    return run


def score(documents: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, score (0 to 1), predicted (1 from 0.5 on).

    Only the text is read.  A null or empty text has the bias' score; rows with null ids and repeated
    rows are scored like any other; other columns are not kept.
    """
    source = two_columns(documents, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def make():
        of, model = kept("toxic-features", 0, Features), shared.value
        dense = model.dense()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums = np.array([_sum(dense, of(t)) + model.bias for t in batch.column(1).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(source, make, schema).withColumnRenamed("id", id_col)


def _sum(dense: np.ndarray, at: np.ndarray) -> float:
    known = at[dense[at] != 0]
    return float(dense[np.unique(known)].sum()) if len(known) else 0.0


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted; learned from the labelled rows that are not held out."""
    scored = score(documents, learn(documents, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (remainder(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, as they were, with all their columns.

    A null text is judged as the empty one (by the bias alone); rows with null ids and repeated rows are judged like any
    other; without a usable label every row stays, and an empty table gives no rows.
    """
    weights = learn(documents, labels, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    names = documents.columns
    at = names.index(text_col)

    def make():
        of, model = kept("toxic-features", 0, Features), shared.value
        dense = model.dense()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            clean = [_sum(dense, of(t or "")) + model.bias < 0 for t in batch.column(at).to_pylist()]
            return batch.filter(pa.array(clean, pa.bool_()))

        return step

    return arrow_map(documents, make, documents.schema)
