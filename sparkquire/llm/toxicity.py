"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, checkpointed, fold, free, labelled_docs
from .textops import BASE, U, chunks, hasher, spans

BITS = 20
SAMPLE = 8_000


def grams(data: np.ndarray, offs: np.ndarray):
    """(document, bucket) arrays, one pair for each kind of feature.

    Kinds: words, word stems of four to seven bytes, pairs of neighbours, and
    pairs with one word between them. Buckets are ``BITS`` bits of a hash.
    """
    starts, ends, first = spans(data, offs)
    of = hasher(data)
    words = of(starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(first))
    cut = lambda h: (h >> U(64 - BITS)).astype(np.int64)
    yield doc, cut(words)
    for k in (4, 5, 6, 7):
        long = np.flatnonzero(ends - starts > k)
        at = starts[long]
        yield doc[long], cut(of(at, at + k) * U(2 * k + 1))
    for gap, factor in ((1, 5), (2, 3)):
        same = doc[gap:] == doc[:-gap]
        yield doc[gap:][same], cut((words[:-gap] * U(factor) + words[gap:])[same] * U(BASE))


def _features(batches):
    """Sorted distinct buckets of each labelled document, as bytes of int32."""
    for batch in batches:
        for at, end, data, offs in chunks(batch, lower=True):
            found = [doc << BITS | bucket for doc, bucket in grams(data, offs)]
            keys = np.unique(np.concatenate(found))
            cuts = np.searchsorted(keys, np.arange(len(offs)) << BITS)
            low = (keys & ((1 << BITS) - 1)).astype(np.int32)
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["doc_id", "label", "features"]
            )


class FTRL:
    """Follow the regularised leader, proximal: a learning rate for each coordinate, L1 and L2."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One case: its distinct coordinates, each with value 1; the last of all, the bias, joins them."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = SAMPLE, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) with weights other than 0; the last bucket, 2**BITS, is the bias.

    Learns from at most ``rows`` labelled documents outside the held-out fold,
    picked by a hash of their ids: the one bound, which keeps the model and its
    training on the driver small. Without a labelled document nothing is known to be toxic: the bias alone is left, at its least.
    """
    pairs = bounded_labels(labels, column, rows)
    none = np.array([1 << BITS]), np.array([-35.0])
    if not pairs:
        return none
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = checkpointed(labelled_docs(docs, pairs).mapInArrow(_features, f"doc_id {kind}, label int, features binary"))
    cases = sorted((r.doc_id, int(r.label > 0), bytes(r.features)) for r in found.toLocalIterator())
    cases = [(np.frombuffer(f, np.int32), y) for _, y, f in cases]
    if not cases:
        return none
    model, order = FTRL((1 << BITS) + 1), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(cases)):
            model.learn(*cases[k])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def _scorer(at: np.ndarray, weights: np.ndarray, name: str):
    """All columns and the text's score."""

    def run(batches):
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[at] = weights
        for batch in batches:
            total = np.full(batch.num_rows, float(w[-1]))
            for a, b, data, offs in chunks(batch, lower=True):
                found = []
                for doc, bucket in grams(data, offs):
                    hit = w[bucket] != 0
                    found.append(doc[hit] << BITS | bucket[hit])
                keys = np.unique(np.concatenate(found))
                total[a:b] += np.bincount(keys >> BITS, w[keys & ((1 << BITS) - 1)].astype(float), b - a)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def _scored(docs: DataFrame, labels: DataFrame, rows: int, name: str, texts: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(*fit(texts, labels, rows=rows), name), f"{fields}, {name} double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text.

    Null texts count as empty and empty texts score the model's prior. Repeated
    rows are scored one by one; a null doc_id counts as empty text in the fold. Texts of any length are
    taken whole. An empty table gives an empty result, without labels all score next to 0. Further columns of ``docs`` are not read.
    """
    out = _scored(docs.select("doc_id", "text"), labels, rows, "score", docs)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def non_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that `toxicity_scores` does not predict as toxic, all columns as they are, whatever their names."""
    name = free(docs, "score")
    return _scored(docs, labels, rows, name, docs).where(F.col(name) < 0.5).drop(name)
